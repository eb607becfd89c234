"""One local session for all tests; nothing here knows the training-data part."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{place}/shared")
        .config("spark.sql.warehouse.dir", f"{place}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the smallest tables as views."""
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(spark_rows: list[tuple], columns: list[str], relation) -> None:
    """The rows equal a DuckDB result, whatever the order of rows and columns; doubles to nine digits."""
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(columns)
    order = [columns.index(n) for n in names]
    clean = lambda r: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)
    ours = sorted((clean(tuple(r[i] for i in order)) for r in spark_rows), key=repr)
    theirs = sorted((clean(r) for r in relation.fetchall()), key=repr)
    assert ours == theirs
