"""Scalar functions, operators and casts of the SQL dialect as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grok import compile_grok
from .syntax import ExpressionError
from .values import BOOL, DOUBLE, LONG, NULL, STRING, VARIANT, Value, converted, storable, text_of, unified

NUMERIC = T.DecimalType(38, 18)


def as_text(v: Value) -> Column:
    return F.lit(None).cast(STRING) if v.kind == "null" else text_of(v)


def as_number(v: Value, t: T.DataType) -> Column:
    """A number as the arithmetic that the left operand picks sees it; texts are read as numbers."""
    if v.kind == "variant":
        return F.try_variant_get(v.col, "$", "double").cast(t)
    if v.kind == "boolean":
        return v.col.cast("int").cast(t)
    if isinstance(t, T.LongType) and v.kind == "string":
        return v.col.cast(DOUBLE).cast(LONG)
    return v.col.cast(t)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """The left operand's type decides: whole numbers stay whole, so 1 + 2.5 is 3 and 7 / 2 is 3."""
    if isinstance(a.type, T.LongType) or a.kind == "null" and not isinstance(b.type, T.FractionalType):
        t: T.DataType = LONG
    elif isinstance(a.type, T.DecimalType):
        t = NUMERIC
    elif a.kind in ("number", "null", "variant"):
        t = DOUBLE
    else:
        raise ExpressionError(f"can't apply {op} to {a.type.simpleString()}")
    x, y = as_number(a, t), as_number(b, t)
    if op == "^":
        return Value(F.pow(x.cast(DOUBLE), y.cast(DOUBLE)).cast(t), t)
    if op == "/":
        return Value(call("div", x, y) if t == LONG else x / y, t)
    if op == "%" and t != LONG:
        raise ExpressionError("% needs whole numbers")
    return Value({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], t)


def call(name: str, *cols: Column) -> Column:
    return F.call_function(name, *cols)


def compared(op: str, a: Value, b: Value) -> Value:
    if a.kind == "null" or b.kind == "null":
        return Value(F.lit(None).cast(BOOL), BOOL)
    if "variant" in (a.kind, b.kind):
        other = b if a.kind == "variant" else a
        to = {"number": "double", "boolean": "boolean"}.get(other.kind, "string")
        x, y = (F.try_variant_get(v.col, "$", to) if v.kind == "variant" else v.col for v in (a, b))
    elif a.kind == b.kind or a.kind == "other" or b.kind == "other":
        x, y = a.col, b.col
    elif a.kind == "number":
        x, y = a.col, as_number(b, a.type)
    elif a.kind == "boolean":
        x, y = a.col, to_boolean(b).col
    else:
        x, y = as_text(a), as_text(b)
    return Value({"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], BOOL)


def truth(v: Value) -> Column:
    return F.lit(None).cast(BOOL) if v.kind == "null" else v.col.cast(BOOL) if v.kind == "boolean" else to_boolean(v).col


def like(v: Value, pattern: Value, insensitive: bool) -> Value:
    """% and _ are the wildcards; a pattern without them is plain equality."""
    if isinstance(pattern.literal, str):
        p = pattern.literal
        regex = "(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p) + "$"
        simple = not insensitive and "_" not in p and "\\" not in p
        text = as_text(v)
        return Value(text.like(p) if simple else text.rlike(("(?i)" if insensitive else "") + regex), BOOL)
    return Value(F.ilike(as_text(v), pattern.col) if insensitive else F.like(as_text(v), pattern.col), BOOL)


def to_boolean(v: Value) -> Value:
    low = F.lower(F.trim(as_text(v)))
    good = F.when(low.isin("true", "t", "yes", "y", "1", "on"), True).when(low.isin("false", "f", "no", "n", "0", "off"), False)
    return Value(F.when(low.isNull(), False).otherwise(F.coalesce(good, F.raise_error(F.concat(F.lit("not a boolean: "), low)).cast(BOOL))), BOOL)


def cast(v: Value, name: str) -> Value:
    """Casts of null give 0, 0.0, false; text and JSON keep null."""
    if name in ("int", "integer", "bigint", "long"):
        if v.kind == "string":
            col = F.coalesce(v.col.try_cast(LONG), v.col.cast(DOUBLE).cast(LONG))
        else:
            col = F.lit(None).cast(LONG) if v.kind == "null" else as_number(v, LONG)
        return Value(F.coalesce(col, F.lit(0).cast(LONG)), LONG)
    if name in ("double precision", "double", "float", "real"):
        return Value(F.coalesce(F.lit(None).cast(DOUBLE) if v.kind == "null" else as_number(v, DOUBLE), F.lit(0.0)), DOUBLE)
    if name in ("numeric", "decimal"):
        return Value(F.coalesce(F.lit(None).cast(NUMERIC) if v.kind == "null" else as_number(v, NUMERIC), F.lit(0).cast(NUMERIC)), NUMERIC)
    if name == "text":
        return Value(as_text(v), STRING)
    if name in ("bool", "boolean"):
        return Value(F.lit(False), BOOL) if v.kind == "null" else Value(F.coalesce(v.col, F.lit(False)), BOOL) if v.kind == "boolean" else Value(F.coalesce(v.col != 0, F.lit(False)), BOOL) if v.kind == "number" else to_boolean(v)
    if name == "json":
        if v.kind == "string":
            return Value(F.parse_json(v.col), VARIANT)
        return v
    if name in ("date", "timestamp"):
        return Value(v.col.cast(name), T.DateType() if name == "date" else T.TimestampType())
    raise ExpressionError(f"unknown type {name}")


def json_get(v: Value, key: Value, as_string: bool) -> Value:
    """A member of a record or list; JSON text is read on the fly; any failure is null."""
    k = key.literal
    if k is ...:
        raise ExpressionError("-> needs a literal key")
    out = Value(F.lit(None), NULL)
    if v.kind == "string":
        v = Value(F.try_parse_json(v.col), VARIANT)
    if v.kind == "variant":
        path = f"$[{k}]" if isinstance(k, int) else "$[" + repr(str(k)) + "]"
        out = Value(F.try_variant_get(v.col, path, "string" if as_string else "variant"), STRING if as_string else VARIANT)
    elif isinstance(v.type, T.StructType) and isinstance(k, str):
        f = next((f for f in v.type if f.name == k), None)
        out = Value(v.col.getField(k), f.dataType) if f else out
    elif isinstance(v.type, T.MapType) and isinstance(k, str):
        out = Value(F.try_element_at(v.col, F.lit(k)), v.type.valueType)
    elif v.kind == "array" and isinstance(k, int):
        out = Value(F.get(v.col, F.lit(k)), v.type.elementType)
    return Value(as_text(out), STRING) if as_string else out


def elements(v: Value) -> Value:
    """The list behind json_array_elements; a record gives its keys."""
    if v.kind == "string":
        v = Value(F.try_parse_json(v.col), VARIANT)
    if v.kind == "variant":
        return Value(F.try_variant_get(v.col, "$", "array<variant>"), T.ArrayType(VARIANT))
    if v.kind == "array":
        return v
    if isinstance(v.type, T.MapType):
        return Value(F.map_keys(v.col), T.ArrayType(STRING))
    if isinstance(v.type, T.StructType):
        return Value(F.array(*[F.lit(f.name) for f in v.type]), T.ArrayType(STRING))
    return Value(F.array().cast("array<string>"), T.ArrayType(STRING))


def pieces(s: Value, regex: Value) -> Column:
    """Parts of a text; trailing empty ones drop, and a blank or null text has none."""
    text = as_text(s)
    parts = F.split(text, as_text(regex))
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.when(text.isNull() | F.trim(text).eqNullSafe(""), F.array().cast("array<string>")).otherwise(F.slice(parts, 1, last))


def round_at(x: Column, n: Column | None, half: float) -> Value:
    if n is None:
        return Value(F.floor(x + F.lit(half)), LONG)
    scale = F.pow(F.lit(10.0), n.cast(DOUBLE))
    return Value(F.floor(x * scale + F.lit(half)).cast(DOUBLE) / scale, DOUBLE)


def euclid(a: Column, b: Column) -> Column:
    """Greatest common divisor by a bounded fold: 32-bit numbers need fewer than 48 steps."""
    start = F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    step = lambda s, _: F.when(s.getField("b") == 0, s).otherwise(F.struct(s.getField("b").alias("a"), F.try_mod(s.getField("a"), s.getField("b")).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s.getField("a"))


def texts(f):
    """A function of texts that gives text."""
    return lambda *a: Value(f(*[as_text(v) for v in a]), STRING)


def doubles(f):
    return lambda *a: Value(f(*[as_number(v, DOUBLE) for v in a]), DOUBLE)


def joined(*a: Value) -> Value:
    return Value(F.concat(*[F.coalesce(as_text(v), F.lit("null")) for v in a]) if a else F.lit(""), STRING)


def build_object(*a: Value) -> Value:
    if len(a) % 2:
        raise ExpressionError("json_build_object takes pairs of key and value")
    keys = [k.literal for k in a[::2]]
    if all(k is not ... for k in keys):
        fields = {str(k): v for k, v in zip(keys, a[1::2])}
        t = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
        return Value(F.struct(*[v.col.alias(k) for k, v in fields.items()]) if fields else F.expr("named_struct()"), t)
    vt: T.DataType = NULL
    for v in a[1::2]:
        vt = unified(vt, v.type)
    vt = storable(vt)
    pairs = F.array(*[F.struct(as_text(k).alias("key"), converted(v.col, v.type, vt).alias("value")) for k, v in zip(a[::2], a[1::2])])
    return Value(F.map_from_entries(pairs), T.MapType(STRING, vt))


def array_length(v: Value) -> Value:
    if v.kind in ("array", "variant"):
        return Value(F.coalesce(F.when(elements(v).col.isNotNull(), F.size(elements(v).col)), F.lit(0)).cast(LONG), LONG)
    return Value(F.lit(0).cast(LONG), LONG)


def grok(pattern: Value, s: Value) -> Value:
    if not isinstance(pattern.literal, str):
        raise ExpressionError("grok needs a literal pattern")
    g = compile_grok(pattern.literal)
    return Value(F.when(g.matches(as_text(s)), g.record(as_text(s))), T.StructType([T.StructField(n, STRING) for n, _ in g.fields]))


def to_hex(v: Value) -> Value:
    return Value(F.lower(F.right(F.concat(F.lit("0" * 7), F.hex(as_number(v, LONG))), F.when(as_number(v, LONG) < 0, 8).otherwise(F.greatest(F.lit(1), F.char_length(F.hex(as_number(v, LONG))))))), STRING)


def length(v: Value) -> Value:
    return Value(F.coalesce(F.char_length(as_text(v)), F.lit(0)).cast(LONG), LONG)


def extreme(pick):
    def build(*a: Value) -> Value:
        t: T.DataType = NULL
        for v in a:
            t = unified(t, v.type)
        return Value(pick(*[converted(v.col, v.type, t) for v in a]) if len(a) > 1 else a[0].col, t)

    return build


def to_time(kind: str, t: T.DataType):
    def build(v: Value, pattern: Value | None = None) -> Value:
        text = as_text(v)
        return Value((F.to_timestamp if kind == "timestamp" else F.to_date)(text, *([str(pattern.literal)] if pattern else [])), t)

    return build


def log_of(f):
    # zero and negative numbers: -Infinity and NaN, as in double arithmetic
    return lambda v: Value(F.when(as_number(v, DOUBLE) > 0, f(as_number(v, DOUBLE))).when(as_number(v, DOUBLE) == 0, F.lit(float("-inf"))).when(as_number(v, DOUBLE).isNotNull(), F.lit(float("nan"))), DOUBLE)


SCALARS = {
    "concat": joined,
    "json_build_object": build_object,
    "json_array_length": array_length,
    "regexp_split_to_array": lambda s, r: Value(pieces(s, r), T.ArrayType(STRING)),
    "replace": texts(F.replace),
    "ltrim": texts(lambda s: F.regexp_replace(s, r"^\s+", "")),
    "rtrim": texts(lambda s: F.regexp_replace(s, r"\s+$", "")),
    "trim": texts(lambda s: F.regexp_replace(s, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")),
    "btrim": texts(lambda s, c=None: F.btrim(s, c) if c is not None else F.btrim(s)),
    "substring": lambda s, a, n: Value(F.substring(as_text(s), as_number(a, LONG).cast("int"), as_number(n, LONG).cast("int")), STRING),
    "left": lambda s, n: Value(F.left(as_text(s), as_number(n, LONG).cast("int")), STRING),
    "right": lambda s, n: Value(F.right(as_text(s), as_number(n, LONG).cast("int")), STRING),
    "upper": texts(F.upper),
    "lower": texts(F.lower),
    "reverse": texts(F.reverse),
    "length": length,
    "char_length": length,
    "position": lambda sub, s: Value(F.coalesce(F.position(as_text(sub), as_text(s)), F.lit(0)).cast(LONG), LONG),
    "split_part": lambda s, d, n: Value(F.when(as_number(n, LONG) > 0, F.get(F.split(as_text(s), as_text(d)), as_number(n, LONG).cast("int") - 1)), STRING),
    "regexp_replace": lambda s, r, to: Value(F.regexp_replace(as_text(s), as_text(r), F.coalesce(as_text(to), F.lit(""))), STRING),
    "regexp_matches": lambda s, r: Value(F.coalesce(F.regexp_extract_all(as_text(s), as_text(r), F.lit(0)), F.array().cast("array<string>")), T.ArrayType(STRING)),
    "format": lambda f, *a: Value(F.format_string(str(f.literal), *[v.col for v in a]), STRING),
    "concat_ws": lambda sep, *a: Value(F.array_join(F.array(*[as_text(v) for v in a]), "" if sep.literal is None else str(sep.literal)) if sep.literal is not ... else call("concat_ws", as_text(sep), *[as_text(v) for v in a]), STRING),
    "md5": texts(F.md5),
    "to_hex": to_hex,
    "grok": grok,
    "abs": doubles(F.abs),
    "ceil": lambda v: Value(F.ceil(as_number(v, DOUBLE)).cast(DOUBLE), DOUBLE),
    "floor": lambda v: Value(F.floor(as_number(v, DOUBLE)).cast(DOUBLE), DOUBLE),
    "sqrt": doubles(F.sqrt),
    "exp": doubles(F.exp),
    "sign": doubles(F.sign),
    "round": lambda x, n=None: round_at(as_number(x, DOUBLE), None if n is None else as_number(n, LONG), 0.5),
    "trunc": lambda x, n=None: round_at(as_number(x, DOUBLE), None if n is None else as_number(n, LONG), 0.0),
    "power": doubles(F.pow),
    "mod": doubles(lambda a, b: F.try_mod(a, b)),
    "gcd": lambda a, b: Value(euclid(as_number(a, LONG), as_number(b, LONG)).cast(LONG), LONG),
    "lcm": lambda a, b: Value((call("div", as_number(a, LONG), euclid(as_number(a, LONG), as_number(b, LONG)).cast(LONG)) * as_number(b, LONG)), LONG),
    "ln": log_of(F.ln),
    "log": log_of(F.ln),
    "log10": log_of(F.log10),
    "log2": log_of(F.log2),
    "degrees": doubles(F.degrees),
    "radians": doubles(F.radians),
    "sin": doubles(F.sin),
    "cos": doubles(F.cos),
    "tan": doubles(F.tan),
    "pi": lambda: Value(F.pi(), DOUBLE),
    "random": lambda: Value(F.rand(), DOUBLE),
    # names that the grammar knows, offered as extensions
    "now": lambda: Value(F.current_timestamp(), T.TimestampType()),
    "to_timestamp": to_time("timestamp", T.TimestampType()),
    "to_date": to_time("date", T.DateType()),
    "date_trunc": lambda unit, v: Value(F.date_trunc(str(unit.literal), v.col), T.TimestampType()),
    "datetrunct": lambda unit, v: Value(F.date_trunc(str(unit.literal), v.col), T.TimestampType()),
    "greatest": extreme(F.greatest),
    "least": extreme(F.least),
    "json_object_keys": lambda v: elements(v) if v.kind == "record" else Value(F.json_object_keys(as_text(v)), T.ArrayType(STRING)),
    "json_strip_nulls": lambda v: Value(F.parse_json(F.to_json(v.col)), VARIANT) if v.kind in ("record", "array") else v,
}
