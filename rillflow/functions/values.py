"""Typed values of the expression language over Spark columns.

A value is a Column, its data type, and the message Column that is non-null on rows where it failed
(None where it can't fail). Failures are data, not exceptions: they route rows to the error output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syntax import ExpressionError

LONG, DOUBLE, STRING, BOOL, NULL, VARIANT = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType(), T.VariantType()


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    err: Column | None = None
    literal: object = ...

    @property
    def kind(self) -> str:
        return kind_of(self.type)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (T.IntegralType, T.FractionalType)):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "record"
    if isinstance(t, T.VariantType):
        return "variant"
    return "other"


def literal(v) -> Value:
    if v is None:
        return Value(F.lit(None), NULL, literal=None)
    if isinstance(v, bool):
        return Value(F.lit(v), BOOL, literal=v)
    if isinstance(v, int):
        return Value(F.lit(v).cast(LONG), LONG, literal=v)
    if isinstance(v, float):
        return Value(F.lit(v), DOUBLE, literal=v)
    return Value(F.lit(v), STRING, literal=v)


def event_value(col: Column, t: T.DataType) -> Value:
    """A stored column as the event model sees it: whole numbers are long, other numbers double, times epoch milliseconds (UTC), dates ISO text."""
    if isinstance(t, T.IntegralType) and not isinstance(t, T.LongType):
        return Value(col.cast(LONG), LONG)
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return Value(col.cast(DOUBLE), DOUBLE)
    if isinstance(t, T.TimestampType):
        return Value(F.unix_millis(col), LONG)
    if isinstance(t, T.TimestampNTZType):
        return Value(F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), col).cast("timestamp")), LONG)
    if isinstance(t, (T.DateType, T.BinaryType, T.CharType, T.VarcharType)) or kind_of(t) == "other":
        return Value(col.cast(STRING), STRING)
    return Value(col, t)


def failing(*errors: Column | None) -> Column | None:
    """The first message of several values, None if none can fail."""
    real = [e for e in errors if e is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


def fail_if(condition: Column, message: str | Column) -> Column:
    return F.when(condition, message if isinstance(message, Column) else F.lit(message))


def unified(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: records get the union of fields, mixed kinds become VARIANT."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if kind_of(a) == kind_of(b) == "number":
        return LONG if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else DOUBLE
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(unified(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        left, right = {f.name: f.dataType for f in a}, {f.name: f.dataType for f in b}
        return T.StructType([T.StructField(n, unified(left.get(n, NULL), right.get(n, NULL))) for n in [*left, *(n for n in right if n not in left)]])
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(STRING, unified(a.valueType, b.valueType))
    if isinstance(a, T.MapType) and isinstance(b, T.StructType) or isinstance(b, T.MapType) and isinstance(a, T.StructType):
        m, s = (a, b) if isinstance(a, T.MapType) else (b, a)
        v = m.valueType
        for f in s:
            v = unified(v, f.dataType)
        return T.MapType(STRING, v)
    return VARIANT


def has_nested_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType) or isinstance(t, T.ArrayType) and has_nested_null(t.elementType) or isinstance(t, T.StructType) and any(has_nested_null(f.dataType) for f in t) or isinstance(t, T.MapType) and has_nested_null(t.valueType)


def storable(t: T.DataType) -> T.DataType:
    """Fields that are always null are stored as strings."""
    if isinstance(t, T.NullType):
        return STRING
    if isinstance(t, T.ArrayType):
        return T.ArrayType(storable(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, storable(f.dataType)) for f in t])
    return T.MapType(t.keyType, storable(t.valueType)) if isinstance(t, T.MapType) else t


def converted(col: Column, t: T.DataType, to: T.DataType) -> Column:
    """A column of type ``t`` in the wider type ``to`` that :func:`unified` or :func:`storable` gave."""
    if t == to:
        return col
    if isinstance(t, T.NullType):
        return F.lit(None).cast(to)
    if isinstance(to, T.VariantType):
        return F.to_variant_object(col) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else col.cast(to)
    if isinstance(to, T.ArrayType):
        return F.transform(col, lambda x: converted(x, t.elementType, to.elementType))
    if isinstance(to, T.StructType):
        own = {f.name: f.dataType for f in t}
        fields = [(converted(col.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in to]
        return F.when(col.isNotNull(), F.struct(*fields)) if fields else col
    if isinstance(to, T.MapType):
        if isinstance(t, T.StructType):
            entries = [x for f in t for x in (F.lit(f.name), converted(col.getField(f.name), f.dataType, to.valueType))]
            return F.when(col.isNotNull(), F.create_map(*entries) if entries else F.create_map().cast(to))
        return F.transform_values(col, lambda _, v: converted(v, t.valueType, to.valueType))
    return col.cast(to)


def as_type(v: Value, to: T.DataType) -> Value:
    return Value(converted(v.col, v.type, to), to, v.err)


def text_of(v: Value) -> Column:
    """A value as text: records and arrays as JSON."""
    if v.kind in ("record", "array", "variant"):
        return F.to_json(v.col)
    return v.col.cast(STRING)


def narrowed(v: Value, kind: str) -> Value:
    """A VARIANT read as the kind that an operation needs; null where it holds something else."""
    if v.kind != "variant":
        return v
    to = {"number": "double", "string": "string", "boolean": "boolean"}[kind]
    t = {"number": DOUBLE, "string": STRING, "boolean": BOOL}[kind]
    col = F.try_variant_get(v.col, "$", to)
    return Value(F.when(F.schema_of_variant(v.col) == "STRING", col) if kind == "string" else col, t, v.err)


def expect(v: Value, what: str, *kinds: str) -> Value:
    """The value if it is null-typed or of one of the kinds; a type error at plan time otherwise."""
    if v.kind == "variant" and len(kinds) == 1 and kinds[0] in ("number", "string", "boolean"):
        return narrowed(v, kinds[0])
    if v.kind == "null" or v.kind in kinds:
        return v
    raise ExpressionError(f"{what} expects {' or '.join(kinds)} but gets {v.type.simpleString()}")
