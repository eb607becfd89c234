"""The expression language: values, nulls, failures, types."""

from __future__ import annotations

import json

import pytest

from rillflow.functions.builtins import FUNCTIONS
from rillflow.functions.compiler import compile_path, compile_template
from rillflow.functions.syntax import ExpressionError, parse
from rillflow.operators.core import assertion, evaluate, keep

EVENT = {"n": 7, "d": 2.5, "s": "Hello World", "b": True, "z": None, "a": [3, 1, 2], "r": {"x": 1, "y": {"k": "v"}}, "l": [{"n": "a", "v": 1}, {"n": "b", "v": 2}], "words": "a.b..", "ip": "10.1.2.3", "t": "2024-01-02T03:04:05Z"}


@pytest.fixture(scope="module")
def event(spark):
    text = spark.createDataFrame([(json.dumps(EVENT),)], "value string")
    schema = "n long, d double, s string, b boolean, z string, a array<long>, r struct<x:long,y:struct<k:string>>, l array<struct<n:string,v:long>>, words string, ip string, t string"
    from pyspark.sql import functions as F

    return text.select(F.from_json("value", schema).alias("e")).select("e.*").cache()


def value(event, expression):
    result = evaluate(event, f"dict(v={expression})")
    rows = result.output.select("v").collect()
    failed = [] if result.errors is None else [r["errorMessage"] for r in result.errors.collect()]
    if failed:
        return "ERROR: " + failed[0]
    v = rows[0][0]
    return v.asDict(True) if hasattr(v, "asDict") else [x.asDict(True) if hasattr(x, "asDict") else x for x in v] if isinstance(v, list) else v


CASES = {
    # literals, paths, precedence
    "1 + 2 * 3": 7,
    "(1 + 2) * 3": 9,
    "$.r.y.k": "v",
    '$["r"]["x"]': 1,
    "$.a[0] + $.a[2]": 5,
    "$.a[-1]": None,
    "$.a[99]": None,
    "$.s.x": None,
    "$.nope.x[0]": None,
    '"a\\"b\\u0041"': 'a"bA',
    "not $.b == true": False,
    # arithmetic
    "$.n / 2": 3.5,
    "-7 % 3": -1,
    "$.n % 0": "ERROR: division by zero",
    "1 / 0": "ERROR: division by zero",
    "$.n - $.d": 4.5,
    "$.n + null": None,
    "9223372036854775807 + 1": 2**63 - 1,
    "-$.s": None,
    "not null": None,
    # logic
    "$.z == null and $.b": True,
    "null or false": False,
    "false and 1 / 0 > 1": False,
    "true or 1 / 0 > 1": True,
    "0.1 + 0.2 == 0.3": True,
    "1 == 1.0000001": True,
    "1 == 'x'": False,
    "$.n < null": None,
    "'a' < 'b'": True,
    # case and dict
    "case($.n > 10 => 'big', $.n > 5 => 'mid', _ => 'small')": "mid",
    "case(false => 1 / 0, _ => 2)": 2.0,
    "case(true => 1, _ => 2.5)": 1.0,
    "dict(a=1, b.c=2, \"q r\"=3, d::e=4)": {"a": 1, "b.c": 2, "q r": 3, "d::e": 4},
    # functions
    "str_contains($.s, 'World')": True,
    "str_split($.words, '.')": ["a", "b", "", ""],
    "str_split('', '.')": [],
    "str_split($.z, '.')": None,
    "str_replace('a.b.c', '.', '-')": "a-b-c",
    "substr('hello', 1)": "ello",
    "substr('hello', -3, 2)": "ll",
    "substr('hello', 9)": "",
    "substr('hello', 1, -1)": "ERROR: substr: negative length",
    "upper($.s)": "HELLO WORLD",
    "concat('a', null, 1, true)": "a1true",
    "concat(null, null)": None,
    "to_str($.a)": "[3,1,2]",
    "parse_int('-17')": -17,
    "parse_int('zz', 36)": 1295,
    "parse_int('x')": "ERROR: parse_int: can't parse x",
    "parse_float('1,234.5 kg')": 1234.5,
    "regex_match('abc', 'b')": False,
    "regex_match_any(array('x', array('abc')[0]), 'a.c')": True,
    "regex_search_any($.s, 'Wor')": True,
    "num_compare_any(array('1', 'x', '20'), 'gt', 10)": True,
    "duration_str_to_mills('1:02:03')": 3723000,
    "duration_str_to_mills('1:70:03')": "ERROR: duration_str_to_mills: can't parse 1:70:03",
    "ts_str_to_epoch('2024-01-02 03:04:05', 'yyyy-MM-dd HH:mm:ss')": 1704164645000,
    "ts_str_to_epoch('Tue, 02 Jan 2024', 'EEE, dd MMM yyyy')": 1704153600000,
    "ts_str_to_epoch('nonsense', 'yyyy')": "ERROR: ts_str_to_epoch: can't parse nonsense",
    "epoch_to_ts_str(1704164645000, \"yyyy-MM-dd'T'HH:mm:ss\")": "2024-01-02T03:04:05",
    "date_component_eq_any($.t, 'week', 1)": True,
    "date_component_eq_any(array(1704164645000), 'hour', 3)": True,
    "date_component_eq_any($.t, 'century', 1)": False,
    "grok('55.3.244.1 GET /i', '%{IP:c} %{WORD:m} %{URIPATH:p}').m": "GET",
    "grok('nothing', '%{IP:c}')": None,
    "cidr_match($.ip, '10.0.0.0/8')": True,
    "cidr_match(array('1.1.1.1', '2001:db8::9'), '2001:db8::/64')": True,
    "cidr_match('x', '10.0.0.0/8')": False,
    "deep_contains($, 'WORLD')": True,
    "deep_contains($.l, 'zzz')": False,
    "size_of($.r)": 2,
    "size_of('abc')": 3,
    "array(1, 2.5)": [1.0, 2.5],
    "range(5)": [0, 1, 2, 3, 4],
    "range(5, 0, -2)": [5, 3, 1],
    "range(1, 5, 0)": "ERROR: range: step is 0",
    "arr_flatten(array(array(1, 2), array(3)))": [1, 2, 3],
    "arr_foreach($.a, x, x * 2)": [6, 2, 4],
    "arr_foreach(array(1, 0, 2), x, 4 / x)": [4.0, 2.0],
    "arr_foreach($.r, x, x.x)": [1],
    "arr_foreach($.l, x, dict(n=x.n, root=$.n))": [{"n": "a", "root": 7}, {"n": "b", "root": 7}],
    "arr_filter($.a, x, x > 1)": [3, 2],
    "arr_filter($.s, x, true)": [],
    "arr_find($.a, x, x < 3)": 1,
    "arr_find($.a, x, x > 30)": None,
    "arr_to_dict($.l, x, x.n, x.v)": {"a": 1, "b": 2},
    "dict_merge($.r, dict(x=9), null)": {"x": 9, "y": {"k": "v"}},
    "dict_remove($.r, 'y', 'nope')": {"x": 1},
    "dict_set($.r, 'x', 'new')": {"x": "new", "y": {"k": "v"}},
    "floor(-1.5)": -2,
    "ceil(1.2)": 2,
    "in(2.0000001, $.a)": True,
    "in(null, $.a)": False,
    "exists($.r.x)": True,
    "exists($.r.nope)": False,
    "exists($.z)": True,
    "exists($.a[5])": False,
    "coalesce(null, $.z, 'd')": "d",
    "arr_foreach($.l, x, arr_foreach($.a, y, x.v * y))[1]": [6, 2, 4],
}


@pytest.mark.parametrize("expression", CASES)
def test_value(event, expression):
    assert value(event, expression) == CASES[expression]


def test_remaining_functions(event):
    row = evaluate(event, "dict(a=now() > 0, b=random_long() == random_long(), c=lower('ÀB'), d=dict_remove_values(dict(x=1, y=dict(z=1, w=array(1, 2))), 1), p=python('def f(x):\\n  return [x, x + 1]', $.n))").output.first()
    assert row["a"] and not row["b"] and row["c"] == "àb"
    assert json.loads(row["d"].toJson()) == {"y": {"w": [2]}}
    assert json.loads(row["p"].toJson()) == [7, 8]
    assert len(FUNCTIONS) == 41


@pytest.mark.parametrize("bad", ["1 +", "$.a[", "foo(1)", "upper()", "dict(a)", "case(true => 1)", "'a' + 1", "1 < 'a'", "x", "a b", "python('import os\\ndef f(): return 1')", "python('def f(): return 1\\ndef g(): return 2')", "parse_int('1', 99)", "1 and true", "upper(1)"])
def test_plan_time_errors(event, bad):
    with pytest.raises(ExpressionError):
        evaluate(event, f"dict(v={bad})")


def test_row_failures_do_not_stop_others(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    r = evaluate(df, "dict(i=parse_int($.s))")
    assert [x[0] for x in r.output.collect()] == [1]
    assert sorted(x["errorMessage"] for x in r.errors.collect()) == ["parse_int: can't parse null", "parse_int: can't parse x"]
    assert keep(df, "parse_int($.s) == 1").output.count() == 1
    a = assertion(df, "parse_int($.s) == 1")
    assert a.output.count() == 1 and a.errors.count() == 2


def test_python_failures_are_rows(spark):
    r = evaluate(spark.range(3), "dict(v=python('def f(x):\\n  return 1 / (x - 1)', $.id))")
    assert r.output.count() == 2 and "ZeroDivision" not in r.errors.first()["errorMessage"]


def test_result_shapes(spark):
    df = spark.range(4)
    assert evaluate(df, "case($.id > 1 => dict(x=$.id), _ => null)").output.count() == 2
    assert evaluate(df, "arr_foreach(range($.id), i, dict(i=i))").output.count() == 6
    assert evaluate(df, "null").output.count() == 0
    bad = evaluate(df, "$.id + 1")
    assert bad.output.count() == 0 and bad.errors.count() == 4
    assert evaluate(df, "dict_remove_values(dict(a=$.id, b=1), 1)").output.columns == ["event"]


def test_dynamic_events(spark):
    df = spark.sql("""SELECT parse_json('{"a": {"b": [1, "x", null]}, "s": "t", "n": 5}') AS event""")
    row = evaluate(df, "dict(a=$.a.b[0] + 1, eq=$.a.b[1] == 'x', s=$.s + 'u', gt=$.n > 4, no=$.s == 5, f=size_of(arr_foreach($.a.b, e, e)))").output.first()
    assert tuple(row) == (2.0, True, "tu", True, False, 3)
    assert keep(df, "$.n == 5 and $.s == 't'").output.count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) d", "cast(id as string) s").write.parquet(str(tmp_path / "p"))
    plan = keep(spark.read.parquet(str(tmp_path / "p")), "$.id > 3 and $.s == '5' and $.d == 5.0").output._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "EqualTo(s,5)" in plan and "GreaterThanOrEqual(d" in plan


def test_paths_and_templates(event):
    assert event.select(compile_path("$.r.y.k", event).col).first()[0] == "v"
    assert event.select(compile_template("n={{ $.n }} k={{$.r.y.k}} z={{ $.z }}", event)).first()[0] == "n=7 k=v z=null"
    with pytest.raises(ExpressionError):
        compile_path("1 + 2", event)
    assert parse("a.b[1].c")
