"""The SQL dialect against expected rows."""

from __future__ import annotations

import pytest

from rillflow import run_sql
from rillflow.functions.syntax import ExpressionError
from tests.conftest import SF, rows


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.createDataFrame([("Rick", "x", 10.5, None), ("rick", "y", -2.5, 3), ("Al", "z", 7.0, 4)], "name string, o string, v double, n int").cache()
    lists = spark.createDataFrame([(1, [1, 2, 3]), (1, [1]), (2, [1, 2]), (3, [])], "a long, b array<long>").cache()
    texts = spark.createDataFrame([('{"k": {"m": [5, "s"]}}', "1,2,,")], "j string, c string").cache()
    return {"records": people, "event": lists, "texts": texts}


CASES = {
    "select 1 + 2.5 a, 2.5 + 1 b, 7 / 2 c, 2 ^ 3 ^ 1 d, -7 % 3 e": [(3, 3.5, 3, 8, -1)],
    "select 'a' || 1 || null": [("a1null",)],
    "select name from records where name like 'Rick%'": [("Rick",)],
    "select name from records where name ilike 'RICK%'": [("Rick",), ("rick",)],
    "select name from records where n is null": [("Rick",)],
    "select name from records where n > 3 or v > 10 and o = 'nope'": [],
    "select not null": [(True,)],
    "select count(*), count(n), count(distinct n), sum(n), min(v), max(v) from records": [(3, 3, 3, 7, -2.5, 10.5)],
    "select count(*) from records where v > 100": [],
    "select sum(n) from records where n is null": [(0,)],
    "select distinct lower(name) from records": [("al",), ("rick",)],
    "select distinct on (lower(name)) name from records order by v": [("Al",), ("rick",)],
    "select name from records order by n desc limit 1": [("Rick",)],
    "select name from records order by n limit 1": [("rick",)],
    "select lower(name) l, count(*) c from records group by lower(name) having count(*) > 1": [("rick", 2)],
    "select a, count(*) from event group by 1, a": [(1, 2), (2, 1), (3, 1)],
    "select r.name, e.a from records r, event e where r.n = e.a + 1": [("Al", 3), ("rick", 2)],
    "select r.name, e.a from records r left join event e on r.n = e.a": [("Al", None), ("Rick", None), ("rick", 3)],
    "select x.s from (select a, sum(a) s from event group by a) x where x.s > 2": [(3,)],
    "select a, json_array_elements(b) from event where a = 2": [(2, 1), (2, 2)],
    "select x, count(*) from event, json_array_elements(b) x group by x": [(1, 3), (2, 2), (3, 1)],
    "select e.a, t.m from event e, lateral (select max(x) m from json_array_elements(e.b) x) t": [(1, 1), (1, 3), (2, 2)],
    "select e.a, t.x from event e, lateral (select x from json_array_elements(e.b) x order by x desc limit 1) t": [(1, 1), (1, 3), (2, 2)],
    "select j->'k'->'m'->>1, (j->'k'->'m'->0)::int, j->'no'->'way' is null from texts": [("s", 5, True)],
    "select json_array_length(regexp_split_to_array(c, ',')) from texts": [(2,)],
    "select x.row from texts, regexp_split_to_table(c, ',') x": [("1",), ("2",)],
    "select x.key, x.value->'m'->>1 from texts, json_each(j) x": [("k", "s")],
    "select x.key, x.value from texts, json_each_text(j->'k') x": [("m", '[5,"s"]')],
    "select x.key, x.value from json_each_text('{\"b\": 1, \"a\": null}') x order by x.key": [("a", None), ("b", "1")],
    "select x.key from json_each('[1]') x": [],
    "select case when v > 5 then 'hi' when v > 0 then 'mid' end from records where o = 'y'": [(None,)],
    "select null::int, null::double precision, null::boolean, null::text, '12.7'::int, 'on'::bool": [(0, 0.0, False, None, 12, True)],
    "select round(2.5), round(-2.5), round(1.25, 1), trunc(-1.5), ceil(1.2), abs(-3)": [(3, -2, 1.3, -2, 2.0, 3.0)],
    "select gcd(12, 18), lcm(4, 6), to_hex(255), to_hex(-1), md5('a')": [(6, 12, "ff", "ffffffff", "0cc175b9c0f1b6a831c399e269772661")],
    "select split_part('a1b2c', '[0-9]', 2), split_part('a', ',', 5), position('b', 'abc'), left('abc', 2), right('abc', 9)": [("b", None, 2, "ab", "abc")],
    "select trim('  a '), ltrim(' \ta'), btrim('xaxy', 'xy'), reverse('abc'), length(null), substring('hello', 2, 3)": [("a", "a", "a", "cba", 0, "ell")],
    "select format('%s!', name), concat_ws('-', name, o) from records where o = 'z'": [("Al!", "Al-z")],
    "select power(2, 10), mod(7, 4), sqrt(9), sign(-2), ln(1), log10(1000) > 2.99, pi() > 3, random() < 1": [(1024.0, 3.0, 3.0, -1.0, 0.0, True, True, True)],
    "select NAME from RECORDS where O = 'z'": [("Al",)],
    "select v between 5 and 8, o in ('x', 'z'), name not like 'R%' from records where o = 'z'": [(True, True, True)],
    "-- a comment\nselect /* inner */ a from event where a = 3;": [(3,)],
    "select grok('%{WORD:w}-%{INT:i}', 'abc-12')->>'i'": [("12",)],
    "select avg(v) > 4.9, string_agg(o, '') <> '' from records": [(True, True)],
}


@pytest.mark.parametrize("statement", list(CASES))
def test_rows(spark, tables, statement):
    assert rows(run_sql(statement, tables, spark)) == sorted(CASES[statement], key=repr)


@pytest.mark.parametrize(
    "bad",
    ["select", "select a from nope", "select nope from event", "select a from event, event", "select a from event e, event f", "select foo(1)", "select name, count(*) from records", "select a from event where", "select 1 +", "select name from records group by o", "select 2.5 % 2"],
)
def test_errors(spark, tables, bad):
    with pytest.raises(ExpressionError):
        run_sql(bad, tables, spark).collect()


def test_names(spark, tables):
    assert run_sql("select v, v * 2, upper(name) u, count(*) from records group by v, v * 2, upper(name)", tables, spark).columns == ["v", "col_1", "u", "col_2"]
    assert run_sql("select json_array_elements(b) from event", tables, spark).columns == ["col_1"]
    assert run_sql("select r.a, e.a from event r, event e", tables, spark).columns == ["a", "e.a"]


def test_zip_pads_the_shorter_list(spark, tables):
    df = spark.createDataFrame([([1, 2], ["a", "b", "c"])], "x array<long>, y array<string>")
    assert rows(run_sql("select json_array_elements(x) x, json_array_elements(y) y from t", {"t": df}, spark)) == [(1, "a"), (2, "b"), (None, "c")]


def test_comma_joins_become_equi_joins(spark, tables):
    plan = run_sql("select r.name from records r, event e where r.n = e.a", tables, spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def pairs(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "n long, o string")
    b = spark.createDataFrame([(1, 5, "7"), (2, 3, "8"), (9, 0, "abc"), (None, 0, "1")], "k long, d long, t string")
    return {"a": a, "b": b}


LEFT, RIGHT = [(1, None), (2, None), (None, None)], [(None, 1), (None, 2), (None, 9), (None, None)]
MATCHES = {
    "a.n = b.k and b.d > 4": [(1, 1)],
    "a.n = b.k and a.o = 'y' and b.d between 1 and 9": [(2, 2)],
    "a.n is not null and a.n = b.k": [(1, 1), (2, 2)],
    "a.n = b.k and (b.d = 5 or a.o = 'y')": [(1, 1), (2, 2)],
    # what fails for rows without a partner is not computed for them
    "a.n = b.k and 10 / b.d > 2": [(2, 2)],
    "a.n = b.k and 7 < b.t": [(2, 2)],
    "b.d >= 0 and a.n = b.k and (b.d = 5 or 10 / b.d = 3)": [(1, 1), (2, 2)],
}


@pytest.mark.parametrize("how", ["", "left", "right", "full"])
@pytest.mark.parametrize("on", MATCHES)
def test_explicit_joins_on_several_conditions_become_equi_joins(spark, pairs, on, how):
    df = run_sql(f"select a.n, b.k from a {how} join b on {on}", pairs, spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    found = MATCHES[on]
    alone = [r for r in LEFT if how in ("left", "full") and r[0] not in [n for n, _ in found]]
    alone += [r for r in RIGHT if how in ("right", "full") and r[1] not in [k for _, k in found]]
    assert rows(df) == sorted(found + alone, key=repr)


def test_filters_of_explicit_joins_reach_the_scan(spark):
    from rillflow.plans.queries import QUERIES

    plan = QUERIES["sql_explicit_joins"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "GreaterThan(o_totalprice,450000.0)" in plan
