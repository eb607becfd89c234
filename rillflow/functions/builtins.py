"""The functions of the expression language, each a builder of a Value from its argument trees."""

from __future__ import annotations

import ast
import ipaddress
import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import syntax as S
from .grok import compile_grok
from .syntax import ExpressionError
from .values import BOOL, DOUBLE, LONG, NULL, STRING, VARIANT, Value, as_type, converted, event_value, expect, fail_if, failing, has_nested_null, literal, narrowed, storable, text_of, unified

FUNCTIONS: dict[str, Callable] = {}


def function(name: str, least: int, most: int | None = ...):
    """Registers an eager function: its builder gets compiled values."""

    def register(build):
        def call(compiler, nodes, scope):
            arity(name, nodes, least, most)
            return build(*[compiler.compile(n, scope) for n in nodes])

        FUNCTIONS[name] = call
        return build

    return register


def lazy(name: str, least: int, most: int | None = ...):
    """Registers a function whose builder compiles its own argument trees."""

    def register(build):
        def call(compiler, nodes, scope):
            arity(name, nodes, least, most)
            return build(compiler, nodes, scope)

        FUNCTIONS[name] = call
        return build

    return register


def arity(name: str, nodes, least: int, most: int | None) -> None:
    most = least if most is ... else most
    if len(nodes) < least or most is not None and len(nodes) > most:
        raise ExpressionError(f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments, not {len(nodes)}")


def constant(v: Value, what: str):
    if v.literal is ...:
        raise ExpressionError(f"{what} must be a literal")
    return v.literal


def null_value(t: T.DataType, *values: Value) -> Value:
    return Value(F.lit(None).cast(t), t, failing(*(v.err for v in values)))


def false_value(*values: Value) -> Value:
    return Value(F.lit(False), BOOL, failing(*(v.err for v in values)))


# --- time ---------------------------------------------------------------------------------------

ZONED = re.compile(r"[XxZzVO]")


def utc_shift(ts: Column, pattern: str) -> Column:
    return ts if ZONED.search(re.sub(r"'[^']*'", "", pattern)) else F.from_utc_timestamp(ts, F.current_timezone())


@function("ts_str_to_epoch", 2)
def ts_str_to_epoch(s, pattern):
    s, p = expect(s, "ts_str_to_epoch", "string"), constant(pattern, "the time pattern")
    text, fmt = s.col, p
    if m := re.match(r"E+(,? *)", p):  # weekdays are read over: they add nothing to a date
        text, fmt = F.regexp_replace(text, r"^\s*[A-Za-z]+,? *", ""), p[m.end() :]
    ts = F.try_to_timestamp(text, F.lit(fmt))
    return Value(F.unix_millis(utc_shift(ts, fmt)), LONG, failing(s.err, fail_if(s.col.isNull() | ts.isNull(), F.concat(F.lit("ts_str_to_epoch: can't parse "), F.coalesce(s.col, F.lit("null"))))))


@function("epoch_to_ts_str", 2)
def epoch_to_ts_str(ms, pattern):
    ms, p = expect(ms, "epoch_to_ts_str", "number"), constant(pattern, "the time pattern")
    ts = F.to_utc_timestamp(F.timestamp_millis(ms.col.cast(LONG)), F.current_timezone())
    return Value(F.date_format(ts, p), STRING, failing(ms.err, fail_if(ms.col.isNull(), "epoch_to_ts_str: no time")))


@function("duration_str_to_mills", 1)
def duration_str_to_mills(s):
    s = expect(s, "duration_str_to_mills", "string")
    good = s.col.rlike(r"^\s*-?[0-9]+:[0-5]?[0-9]:[0-5]?[0-9]\s*$")
    part = lambda i: F.element_at(F.split(F.trim(s.col), ":"), i).cast(LONG)
    value = F.when(good, ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000)
    return Value(value, LONG, failing(s.err, fail_if(~F.coalesce(good, F.lit(False)), F.concat(F.lit("duration_str_to_mills: can't parse "), F.coalesce(s.col, F.lit("null"))))))


@function("now", 0)
def now():
    return Value(F.unix_millis(F.current_timestamp()), LONG)


def any_element(v: Value, test: Callable[[Value], Column]) -> Column:
    """Whether a scalar, or any element of a (nested) array, passes; null never does."""
    if v.kind == "array":
        if v.type.elementType == NULL:
            return F.lit(False)
        return F.coalesce(F.exists(v.col, lambda x: any_element(event_value(x, v.type.elementType), test)), F.lit(False))
    if v.kind == "variant":
        inner = F.exists(F.coalesce(F.try_variant_get(v.col, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(test(Value(x, VARIANT)), F.lit(False)))
        return F.coalesce(test(v), F.lit(False)) | inner
    return F.coalesce(test(v), F.lit(False))


@function("date_component_eq_any", 3)
def date_component_eq_any(v, unit, n):
    n, u = expect(n, "date_component_eq_any", "number"), str(constant(unit, "the unit")).lower()
    part = {"minute": "minute", "hour": "hour", "day": "day", "week": "week", "month": "month", "year": "year"}.get(u)
    if part is None:
        return false_value(v, n)

    def test(x: Value) -> Column:
        if x.kind == "number":
            ts = F.timestamp_millis(x.col.cast(LONG))
        elif x.kind in ("string", "variant"):
            text = F.trim(narrowed(x, "string").col)
            iso = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d(:\d\d)?)(\[.+\])?$")
            ts = F.when(iso, F.try_to_timestamp(F.regexp_replace(text, r"\[.+\]$", "")))
        else:
            return F.lit(False)
        return F.date_part(F.lit(part), F.to_utc_timestamp(ts, F.current_timezone())).cast(LONG) == n.col.cast(LONG)

    return Value(any_element(v, test), BOOL, failing(v.err, n.err))


# --- text ---------------------------------------------------------------------------------------


@function("str_contains", 2)
def str_contains(s, sub):
    s, sub = expect(s, "str_contains", "string"), expect(sub, "str_contains", "string")
    return Value(F.coalesce(F.contains(s.col.cast(STRING), sub.col.cast(STRING)), F.lit(False)), BOOL, failing(s.err, sub.err))


@function("str_split", 2)
def str_split(s, delim):
    s, d = expect(s, "str_split", "string"), expect(delim, "str_split", "string")
    t, err = T.ArrayType(STRING), failing(s.err, delim.err)
    if s.kind == "null":
        return null_value(t, s, d)
    if d.kind == "null":
        return Value(F.when(s.col.isNotNull(), F.array(s.col)), t, err)
    parts = F.split(s.col, F.concat(F.lit("\\Q"), F.replace(d.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    col = F.when(s.col.isNull(), None).when(d.col.isNull(), F.array(s.col)).when(s.col == "", F.array().cast(t)).when(d.col == "", F.filter(F.split(s.col, "", -1), lambda x: x != "")).otherwise(parts)
    return Value(col, t, err)


@function("str_replace", 3)
def str_replace(s, target, repl):
    s, a, b = (expect(x, "str_replace", "string") for x in (s, target, repl))
    return Value(F.replace(s.col.cast(STRING), a.col.cast(STRING), b.col.cast(STRING)), STRING, failing(s.err, a.err, b.err))


@function("substr", 2, 3)
def substr(s, start, length=None):
    s, at = expect(s, "substr", "string"), expect(start, "substr", "number")
    n = F.char_length(s.col.cast(STRING))
    i = at.col.cast("int")
    begin = F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(i)
    err = failing(s.err, at.err)
    if length is None:
        size = n
    else:
        length = expect(length, "substr", "number")
        size = length.col.cast("int")
        err = failing(err, length.err, fail_if(size < 0, "substr: negative length"))
    col = F.when(begin >= n, F.when(s.col.isNotNull(), F.lit(""))).otherwise(F.substring(s.col, begin + 1, F.greatest(size, F.lit(0))))
    return Value(col, STRING, err)


def mapped(name: str, apply: Callable[[Column], Column]):
    @function(name, 1)
    def build(s):
        s = expect(s, name, "string")
        return Value(apply(s.col.cast(STRING)), STRING, s.err)


mapped("upper", F.upper)
mapped("lower", F.lower)


@function("concat", 1, None)
def concat(*values):
    real = [v for v in values if v.kind != "null"]
    err = failing(*(v.err for v in values))
    if not real:
        return null_value(STRING, *values)
    nothing = real[0].col.isNull()
    for v in real[1:]:
        nothing = nothing & v.col.isNull()
    return Value(F.when(~nothing, F.concat_ws("", *[text_of(v) for v in real])), STRING, err)


@function("to_str", 1)
def to_str(v):
    return Value(text_of(v) if v.kind != "null" else F.lit(None).cast(STRING), STRING, v.err)


@function("parse_int", 1, 2)
def parse_int(s, radix=None):
    s = expect(s, "parse_int", "string")
    base = 10 if radix is None else int(constant(radix, "the radix"))
    if not 2 <= base <= 36:
        raise ExpressionError("parse_int: the radix is not in 2 to 36")
    digits = "0-9" if base >= 10 else f"0-{base - 1}"
    letters = "" if base <= 10 else f"A-{chr(54 + base)}a-{chr(86 + base)}"
    good = s.col.rlike(rf"^[+-]?[{digits}{letters}]+$")
    if base == 10:
        col = F.when(good, s.col.try_cast(LONG))
    else:
        size = F.conv(F.regexp_replace(s.col, "^[+-]", ""), base, 10).try_cast(LONG)
        col = F.when(good, F.when(s.col.startswith("-"), -size).otherwise(size))
    return Value(col, LONG, failing(s.err, fail_if(col.isNull(), F.concat(F.lit("parse_int: can't parse "), F.coalesce(s.col, F.lit("null"))))))


@function("parse_float", 1)
def parse_float(s):
    s = expect(s, "parse_float", "string")
    head = F.regexp_extract(s.col, r"^(-?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:E-?[0-9]+)?)", 1)
    col = F.regexp_replace(head, ",", "").try_cast(DOUBLE)
    return Value(col, DOUBLE, failing(s.err, fail_if(col.isNull(), F.concat(F.lit("parse_float: can't parse "), F.coalesce(s.col, F.lit("null"))))))


def whole(regex: Column) -> Column:
    return F.concat(F.lit("\\A(?:"), regex, F.lit(")\\z"))


@function("regex_match", 2)
def regex_match(s, pattern):
    s, p = expect(s, "regex_match", "string"), expect(pattern, "regex_match", "string")
    return Value(F.coalesce(F.rlike(s.col.cast(STRING), whole(p.col.cast(STRING))), F.lit(False)), BOOL, failing(s.err, p.err))


def regex_any(name: str, wrap: Callable[[Column], Column]):
    @function(name, 2)
    def build(v, pattern):
        p = expect(pattern, name, "string")
        test = lambda x: F.rlike(text_of(narrowed(x, "string") if x.kind == "variant" else x), wrap(p.col.cast(STRING))) if x.kind in ("string", "number", "boolean", "variant") else F.lit(False)
        return Value(any_element(v, test), BOOL, failing(v.err, p.err))


regex_any("regex_match_any", whole)
regex_any("regex_search_any", lambda p: p)


@function("num_compare_any", 3)
def num_compare_any(v, op, n):
    o, n = constant(op, "the operator"), expect(n, "num_compare_any", "number")
    if o not in ("lt", "lte", "gt", "gte"):
        raise ExpressionError(f"num_compare_any: unknown operator {o}")

    def test(x: Value) -> Column:
        if x.kind not in ("number", "string", "variant"):
            return F.lit(False)
        y = narrowed(x, "number").col.cast(DOUBLE) if x.kind != "string" else F.trim(x.col).try_cast(DOUBLE)
        m = n.col.cast(DOUBLE)
        return {"lt": y < m, "lte": y <= m, "gt": y > m, "gte": y >= m}[o]

    return Value(any_element(v, test), BOOL, failing(v.err, n.err))


@function("grok", 2)
def grok(s, pattern):
    s, g = expect(s, "grok", "string"), compile_grok(constant(pattern, "the grok pattern"))
    t = T.StructType([T.StructField(n, STRING) for n, _ in g.fields])
    if not g.fields:
        return Value(F.expr("named_struct()"), T.StructType([]), s.err)
    text = s.col.cast(STRING)
    nothing = F.struct(*[F.lit(None).cast(STRING).alias(n) for n, _ in g.fields])
    return Value(F.when(text.isNull(), nothing).when(g.matches(text), g.record(text)), t, s.err)


# --- networks and nested search -------------------------------------------------------------------


@F.pandas_udf(BOOL)
def in_network(ip: pd.Series, cidr: pd.Series) -> pd.Series:
    nets: dict = {}

    def one(a, c):
        try:
            if c not in nets:
                nets[c] = ipaddress.ip_network(c.strip(), strict=False)
            return ipaddress.ip_address(a.strip()) in nets[c]
        except (ValueError, AttributeError):
            return False

    return pd.Series([one(a, c) for a, c in zip(ip, cidr)], dtype=bool)


V4 = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})/(\d{1,2})")


@function("cidr_match", 2)
def cidr_match(ip, cidr):
    err = failing(ip.err, cidr.err)
    net = None
    if isinstance(cidr.literal, str):
        try:
            net = ipaddress.ip_network(cidr.literal.strip(), strict=False)
        except ValueError:
            return false_value(ip, cidr)
    if ip.kind not in ("string", "array") or expect(cidr, "cidr_match", "string").kind == "null":
        return false_value(ip, cidr)

    def v4(x: Value) -> Column:
        if x.kind != "string":
            return F.lit(False)
        parts = F.split(F.trim(x.col), "\\.")
        good = F.trim(x.col).rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")
        number = parts[0].cast(LONG) * 16777216 + parts[1].cast(LONG) * 65536 + parts[2].cast(LONG) * 256 + parts[3].cast(LONG)
        lo = int(net.network_address)
        return F.when(good, number.between(lo, lo + net.num_addresses - 1)).otherwise(False)

    if net is not None and net.version == 4:
        return Value(any_element(ip, v4), BOOL, err)
    if ip.kind == "array":
        # a Python function can't run inside a lambda: the elements are matched as one comma-free text each
        @F.pandas_udf(BOOL)
        def any_in(ips: pd.Series, nets: pd.Series) -> pd.Series:
            def one(addresses, c):
                if addresses is None or c is None:
                    return False
                for a in addresses:
                    try:
                        if ipaddress.ip_address(str(a).strip()) in ipaddress.ip_network(c.strip(), strict=False):
                            return True
                    except ValueError:
                        pass
                return False

            return pd.Series([one(a, c) for a, c in zip(ips, nets)], dtype=bool)

        return Value(any_in(ip.col.cast("array<string>"), cidr.col), BOOL, err)
    return Value(F.coalesce(in_network(ip.col, cidr.col), F.lit(False)), BOOL, err)


@function("deep_contains", 2)
def deep_contains(v, needle):
    n = expect(needle, "deep_contains", "string")
    low = F.lower(n.col.cast(STRING))

    def search(x: Value) -> Column:
        if x.kind == "null":
            return F.lit(False)
        if isinstance(x.type, T.StructType):
            tests = [search(event_value(x.col.getField(f.name), f.dataType)) for f in x.type]
            out = F.lit(False)
            for t in tests:
                out = out | t
            return out
        if isinstance(x.type, T.MapType):
            return F.coalesce(F.exists(F.map_values(x.col), lambda e: search(event_value(e, x.type.valueType))), F.lit(False))
        if x.kind == "array":
            return F.coalesce(F.exists(x.col, lambda e: search(event_value(e, x.type.elementType))), F.lit(False))
        if x.kind == "variant":
            return F.coalesce(variant_contains(F.to_json(x.col), low), F.lit(False))
        return F.coalesce(F.contains(F.lower(x.col.cast(STRING)), low), F.lit(False))

    return Value(search(v), BOOL, failing(v.err, n.err))


@F.pandas_udf(BOOL)
def variant_contains(texts: pd.Series, needles: pd.Series) -> pd.Series:
    def search(node, needle) -> bool:
        if isinstance(node, dict):
            return any(search(x, needle) for x in node.values())
        if isinstance(node, list):
            return any(search(x, needle) for x in node)
        return node is not None and needle in (json.dumps(node) if not isinstance(node, str) else node).lower()

    return pd.Series([t is not None and n is not None and search(json.loads(t), n) for t, n in zip(texts, needles)], dtype=bool)


# --- arrays ---------------------------------------------------------------------------------------


@function("size_of", 1)
def size_of(v):
    if v.kind == "null":
        return null_value(LONG, v)
    if v.kind == "string":
        return Value(F.char_length(v.col).cast(LONG), LONG, v.err)
    if isinstance(v.type, T.StructType):
        return Value(F.when(v.col.isNotNull(), F.lit(len(v.type)).cast(LONG)), LONG, v.err)
    if v.kind in ("array", "record"):
        return Value(F.when(v.col.isNotNull(), F.size(v.col).cast(LONG)), LONG, v.err)
    raise ExpressionError(f"size_of: {v.type.simpleString()} has no size")


@function("array", 0, None)
def array(*values):
    t: T.DataType = NULL
    for v in values:
        t = unified(t, v.type)
    col = F.array(*[converted(v.col, v.type, t) for v in values]) if values else F.array()
    return Value(col, T.ArrayType(t), failing(*(v.err for v in values)))


@function("range", 1, 3)
def range_(*values):
    a = [expect(v, "range", "number") for v in values]
    start = a[0].col.cast(LONG) if len(a) > 1 else F.lit(0).cast(LONG)
    end = a[1 if len(a) > 1 else 0].col.cast(LONG)
    step = a[2].col.cast(LONG) if len(a) == 3 else F.lit(1).cast(LONG)
    count = F.when(step > 0, F.ceil((end - start) / step)).otherwise(F.ceil((start - end) / -step))
    err = failing(*(v.err for v in a), fail_if(step == 0, "range: step is 0"), fail_if(F.when(step != 0, count) > 1_000_000, "range: more than 1000000 elements"))
    good = (step != 0) & (count > 0) & (count <= 1_000_000)
    col = F.when(F.coalesce(good, F.lit(False)), F.transform(F.sequence(F.lit(0).cast(LONG), F.when(good, count - 1).otherwise(0).cast(LONG)), lambda i: start + i * step)).otherwise(F.array().cast("array<bigint>"))
    return Value(col, T.ArrayType(LONG), err)


@function("arr_flatten", 1)
def arr_flatten(v):
    v = expect(v, "arr_flatten", "array")
    if v.kind == "null":
        raise ExpressionError("arr_flatten: not an array")
    err = failing(v.err, fail_if(v.col.isNull(), "arr_flatten: not an array"))
    inner = v.type.elementType
    if isinstance(inner, T.ArrayType):
        # a null element stays an element
        col = F.flatten(F.transform(v.col, lambda x: F.coalesce(x, F.array(F.lit(None).cast(inner.elementType)))))
        return Value(col, inner, err)
    if isinstance(inner, T.VariantType):
        one = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
        return Value(F.flatten(F.transform(v.col, one)), v.type, err)
    return Value(v.col, v.type, err)


def elements(v: Value) -> Value | None:
    """The array to walk: a record is an array of itself; None for what can't be walked."""
    if v.kind == "array":
        return v
    if v.kind == "record":
        return Value(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type), v.err)
    if v.kind == "variant":
        return Value(F.try_variant_get(v.col, "$", "array<variant>"), T.ArrayType(VARIANT), v.err)
    return None


def name_of(node, what: str) -> str:
    if not isinstance(node, S.Variable):
        raise ExpressionError(f"{what}: the second argument must be a name")
    return node.name


def body(compiler, node, scope, name, element: Column, t: T.DataType) -> Value:
    return compiler.compile(node, scope | {name: event_value(element, t)})


def probe(compiler, node, scope, name, t: T.DataType) -> Value:
    """The body's type and whether it can fail, from a stand-in element."""
    return body(compiler, node, scope, name, F.lit(None).cast(t) if not isinstance(t, T.NullType) else F.lit(None), t)


@lazy("arr_foreach", 3)
def arr_foreach(compiler, nodes, scope):
    source, name = elements(compiler.compile(nodes[0], scope)), name_of(nodes[1], "arr_foreach")
    if source is None:
        return Value(F.lit(None), NULL)
    t = source.type.elementType
    shape = probe(compiler, nodes[2], scope, name, t)
    if shape.err is None:
        col = F.transform(source.col, lambda x: body(compiler, nodes[2], scope, name, x, t).col)
    else:  # a failing element is left out

        def tried(x):
            v = body(compiler, nodes[2], scope, name, x, t)
            return F.struct(v.col.alias("v"), v.err.alias("e"))

        col = F.transform(F.filter(F.transform(source.col, tried), lambda r: r.getField("e").isNull()), lambda r: r.getField("v"))
    return Value(col, T.ArrayType(shape.type), source.err)


def chosen(compiler, nodes, scope, what: str) -> Value | None:
    source, name = compiler.compile(nodes[0], scope), name_of(nodes[1], what)
    source = elements(source) if source.kind in ("array", "variant") else None
    if source is None:
        return None
    t = source.type.elementType

    def test(x):
        v = expect(body(compiler, nodes[2], scope, name, x, t), what, "boolean")
        good = F.coalesce(v.col.cast(BOOL), F.lit(False))
        return good if v.err is None else good & v.err.isNull()

    return Value(F.filter(source.col, test), source.type, source.err)


@lazy("arr_filter", 3)
def arr_filter(compiler, nodes, scope):
    v = chosen(compiler, nodes, scope, "arr_filter")
    return Value(F.array(), T.ArrayType(NULL)) if v is None else Value(F.coalesce(v.col, F.array().cast(storable(v.type))) if not has_nested_null(v.type) else v.col, v.type, v.err)


@lazy("arr_find", 3)
def arr_find(compiler, nodes, scope):
    v = chosen(compiler, nodes, scope, "arr_find")
    if v is None:
        return Value(F.lit(None), NULL)
    first = event_value(F.get(v.col, F.lit(0)), v.type.elementType)
    return Value(first.col, first.type, v.err)


@lazy("arr_to_dict", 4)
def arr_to_dict(compiler, nodes, scope):
    source, name = elements(compiler.compile(nodes[0], scope)), name_of(nodes[1], "arr_to_dict")
    if source is None:
        raise ExpressionError("arr_to_dict: not an array")
    t = source.type.elementType
    key, value = (probe(compiler, n, scope, name, t) for n in nodes[2:])
    if key.kind not in ("string", "variant"):
        raise ExpressionError("arr_to_dict: keys must be strings")
    vt = storable(value.type)
    at = lambda n: lambda x: body(compiler, n, scope, name, x, t)
    keys = F.transform(source.col, lambda x: narrowed(at(nodes[2])(x), "string").col)
    values = F.transform(source.col, lambda x: converted(at(nodes[3])(x).col, value.type, vt))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return Value(F.map_from_entries(last_of_each(pairs)), T.MapType(STRING, vt), failing(source.err, fail_if(F.exists(keys, lambda k: k.isNull()), "arr_to_dict: a key is no string")))


def last_of_each(pairs: Column) -> Column:
    """Entries without those whose key comes again later, and without null keys: independent of the session's duplicate-key policy."""
    n = F.size(pairs)
    later = lambda i: F.slice(F.transform(pairs, lambda p: p.getField("key")), i + 2, F.greatest(n - i - 1, F.lit(0)))
    return F.filter(pairs, lambda p, i: p.getField("key").isNotNull() & ~F.array_contains(later(i), p.getField("key")))


# --- records --------------------------------------------------------------------------------------


def as_map(v: Value, vt: T.DataType) -> Column:
    return converted(v.col, v.type, T.MapType(STRING, vt))


def merged_maps(values: list[Value]) -> Value:
    vt: T.DataType = NULL
    for v in values:
        inner = [v.type.valueType] if isinstance(v.type, T.MapType) else [f.dataType for f in v.type]
        for t in inner:
            vt = unified(vt, t)
    vt = storable(vt)
    empty = F.create_map().cast(T.MapType(STRING, vt))
    entries = F.concat(*[F.map_entries(F.coalesce(as_map(v, vt), empty)) for v in values])
    return Value(F.map_from_entries(last_of_each(entries)), T.MapType(STRING, vt), failing(*(v.err for v in values)))


@function("dict_merge", 1, None)
def dict_merge(*values):
    real = [v for v in values if v.kind != "null"]
    for v in real:
        expect(v, "dict_merge", "record")
    if not real:
        return Value(F.expr("named_struct()"), T.StructType([]), failing(*(v.err for v in values)))
    if any(isinstance(v.type, T.MapType) for v in real):
        return merged_maps(real)
    fields: dict[str, Value] = {}
    for v in real:
        for f in v.type:
            new, old = v.col.getField(f.name), fields.get(f.name)
            if old is None or repr(v.col).startswith("Column<'struct("):  # a constructed record is never null
                fields[f.name] = Value(new, f.dataType)
            else:
                t = unified(old.type, f.dataType)
                fields[f.name] = Value(F.when(v.col.isNotNull(), converted(new, f.dataType, t)).otherwise(converted(old.col, old.type, t)), t)
    t = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
    return Value(F.struct(*[v.col.alias(k) for k, v in fields.items()]) if fields else F.expr("named_struct()"), t, failing(*(v.err for v in values)))


@function("dict_remove", 2, None)
def dict_remove(d, *keys):
    if d.kind == "null":
        return d
    d = expect(d, "dict_remove", "record")
    names = [constant(k, "a key to remove") for k in keys]
    if isinstance(d.type, T.MapType):
        return Value(F.map_filter(d.col, lambda k, _: ~k.isin([n for n in names if n is not None])), d.type, d.err)
    left = [f for f in d.type if f.name not in names]
    col = F.struct(*[d.col.getField(f.name).alias(f.name) for f in left]) if left else F.expr("named_struct()")
    return Value(F.when(d.col.isNotNull(), col) if left else col, T.StructType(left), d.err)


@F.pandas_udf(STRING)
def without_values(records: pd.Series, removed: pd.Series) -> pd.Series:
    def same(a, b) -> bool:
        if isinstance(a, bool) or isinstance(b, bool):
            return a is b
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return math.isclose(a, b, rel_tol=0, abs_tol=1e-6)
        return type(a) is type(b) and a == b

    def strip(node, gone):
        if isinstance(node, dict):
            return {k: strip(x, gone) for k, x in node.items() if not any(same(x, g) for g in gone)}
        if isinstance(node, list):
            return [strip(x, gone) for x in node if not any(same(x, g) for g in gone)]
        return node

    return pd.Series([None if r is None else json.dumps(strip(json.loads(r), json.loads(g)), ensure_ascii=False) for r, g in zip(records, removed)], dtype=object)


@function("dict_remove_values", 2, None)
def dict_remove_values(d, *values):
    """The keys that stay depend on the data, so the result is a VARIANT."""
    if d.kind == "null":
        return d
    d = expect(d, "dict_remove_values", "record", "variant")
    gone = array(*values)
    t = T.ArrayType(storable(gone.type.elementType))
    keep_nulls = {"ignoreNullFields": "false"}
    record = F.to_json(d.col, keep_nulls) if d.kind == "record" else F.to_json(d.col)
    return Value(F.parse_json(without_values(record, F.to_json(as_type(gone, t).col, keep_nulls))), VARIANT, failing(d.err, gone.err))


@function("dict_set", 3, None)
def dict_set(d, *pairs):
    if len(pairs) % 2:
        raise ExpressionError("dict_set takes a record and pairs of key and value")
    d = expect(d, "dict_set", "record")
    if d.kind == "null":
        d = Value(F.expr("named_struct()"), T.StructType([]), d.err)
    for k, v in zip(pairs[::2], pairs[1::2]):
        if k.literal is None:
            continue
        if isinstance(d.type, T.StructType) and isinstance(k.literal, str):
            one = Value(F.struct(v.col.alias(k.literal)), T.StructType([T.StructField(k.literal, v.type)]), v.err)
            d = dict_merge(d, one)
        else:
            vt = storable(v.type)
            key = expect(k, "dict_set", "string")
            one = Value(F.map_from_entries(F.filter(F.array(F.struct(key.col.cast(STRING).alias("key"), converted(v.col, v.type, vt).alias("value"))), lambda e: e.getField("key").isNotNull())), T.MapType(STRING, vt), failing(v.err, k.err))
            d = merged_maps([d, one])
    return d


# --- numbers and the rest -------------------------------------------------------------------------


def rounding(name: str, apply):
    @function(name, 1)
    def build(v):
        v = expect(v, name, "number")
        return Value(apply(v.col.cast(DOUBLE)).cast(LONG), LONG, failing(v.err, fail_if(v.col.isNull(), f"{name}: not a number")))


rounding("floor", F.floor)
rounding("ceil", F.ceil)


@function("random_long", 0)
def random_long():
    return Value(F.xxhash64(F.uuid()), LONG)


@function("in", 2)
def in_(v, items):
    from .compiler import equal

    if items.kind not in ("array", "variant") or v.kind == "null":
        return false_value(v, items)
    walk = elements(items)
    test = lambda x: equal(event_value(x, walk.type.elementType), v)
    return Value(F.coalesce(v.col.isNotNull() & F.exists(walk.col, test), F.lit(False)), BOOL, failing(v.err, items.err))


@lazy("exists", 1)
def exists(compiler, nodes, scope):
    node = nodes[0]
    if isinstance(node, (S.Root, S.Variable)):
        return Value(F.lit(True) if isinstance(node, S.Root) else compiler.compile(node, scope).col.isNotNull(), BOOL)
    if not isinstance(node, (S.Field, S.Index)):
        raise ExpressionError("exists expects a path such as $.a.b")
    if isinstance(node, S.Field) and isinstance(node.base, S.Root):
        return Value(F.lit(any(f.name == node.name for f in compiler.schema)), BOOL)
    base = compiler.compile(node.base, scope)
    key = node.name if isinstance(node, S.Field) else None
    at = None if key is not None else compiler.compile(node.index, scope)
    if at is not None and isinstance(at.literal, str):
        key = at.literal
    if isinstance(base.type, T.StructType):
        return Value(base.col.isNotNull() if key is not None and any(f.name == key for f in base.type) else F.lit(False), BOOL, base.err)
    if isinstance(base.type, T.MapType) and key is not None:
        return Value(F.coalesce(F.map_contains_key(base.col, key), F.lit(False)), BOOL, base.err)
    if base.kind == "array" and at is not None and at.kind == "number":
        return Value(F.coalesce((F.size(base.col) > at.col) & (at.col >= 0), F.lit(False)), BOOL, base.err)
    if base.kind == "variant":
        v = compiler.compile(node, scope)
        return Value(v.col.isNotNull(), BOOL, base.err)
    return false_value(base)


@function("coalesce", 1, None)
def coalesce(*values):
    t: T.DataType = NULL
    for v in values:
        t = unified(t, v.type)
    if isinstance(t, T.NullType):
        return Value(F.lit(None), NULL, failing(*(v.err for v in values)))
    return Value(F.coalesce(*[converted(v.col, v.type, t) for v in values]), t, failing(*(v.err for v in values)))


SAFE = ("abs", "all", "any", "bool", "chr", "dict", "divmod", "enumerate", "filter", "float", "int", "isinstance", "len", "list", "map", "max", "min", "ord", "pow", "range", "repr", "reversed", "round", "set", "sorted", "str", "sum", "tuple", "zip", "Exception", "ValueError", "TypeError", "KeyError")


def single_function(script: str) -> tuple[str, ast.FunctionDef]:
    """The one function a script defines at its top level."""
    try:
        tree = ast.parse(script)
    except SyntaxError as e:
        raise ExpressionError(f"python: {e}") from None
    found = [n for n in tree.body if isinstance(n, ast.FunctionDef)]
    if len(found) != 1:
        raise ExpressionError(f"python: the script must define exactly one function, not {len(found)}")
    if any(isinstance(n, (ast.Import, ast.ImportFrom)) or isinstance(n, ast.Attribute) and n.attr.startswith("__") for n in ast.walk(tree)):
        raise ExpressionError("python: imports and dunder attributes are not allowed")
    return found[0].name, found[0]


@function("python", 1, None)
def python(script, *args):
    """Runs the script's function on each row (Arrow batches), with a few builtins only; the result is a VARIANT."""
    import builtins

    text = constant(script, "the script")
    name, definition = single_function(text)
    n = len(definition.args.args)
    if n != len(args):
        raise ExpressionError(f"python: {name} takes {n} arguments, not {len(args)}")
    given = F.to_json(F.struct(*[converted(v.col, v.type, storable(v.type)).alias(f"a{i}") for i, v in enumerate(args)], F.lit(1).alias("z")), {"ignoreNullFields": "false"})

    @F.pandas_udf("out string, err string")
    def run(rows: pd.Series) -> pd.DataFrame:
        scope = {"__builtins__": {b: getattr(builtins, b) for b in SAFE}}
        exec(compile(text, "<script>", "exec"), scope)  # noqa: S102
        out, errors = [], []
        for r in rows:
            d = json.loads(r)
            try:
                out.append(json.dumps(scope[name](*[d[f"a{i}"] for i in range(n)])))
                errors.append(None)
            except Exception as e:  # the row fails, not the job
                out.append(None)
                errors.append(f"python: {e}")
        return pd.DataFrame({"out": out, "err": errors})

    result = run(given)
    return Value(F.parse_json(result.getField("out")), VARIANT, failing(*(v.err for v in args), result.getField("err")))
