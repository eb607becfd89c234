"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from rillflow.plans.queries import ORACLES, QUERIES
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    same([tuple(r) for r in df.collect()], df.columns, duck.execute(ORACLES[name]))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
