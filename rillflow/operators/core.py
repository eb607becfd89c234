"""Per-event nodes: noop, eval, filter and assertion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import syntax
from ..functions.compiler import EVENT, Compiler
from ..functions.syntax import ExpressionError
from ..functions.values import BOOL, Value, converted, expect, storable
from .base import Result, all_failed, split


def noop(df: DataFrame) -> Result:
    return Result(df)


def evaluate(df: DataFrame, expression: str, *, lenient: bool = False, functions=None) -> Result:
    """``eval``: a record gives a row, an array a row per record in it, null none; anything else is an error.

    With ``lenient``, fields of a top-level dict that can't be compiled hold the message instead.
    """
    compiler, tree = Compiler(df.schema, functions), syntax.parse(expression)
    if lenient and isinstance(tree, syntax.Record):
        tree = forgiving(compiler, tree)
    return shaped(df, compiler.compile(tree))


def forgiving(compiler: Compiler, tree: syntax.Record) -> syntax.Record:
    pairs = []
    for key, node in tree.pairs:
        if isinstance(node, syntax.Record):
            node = forgiving(compiler, node)
        try:
            compiler.compile(node)
        except ExpressionError as e:
            node = syntax.Literal(f">>> Failed to evaluate expression: {e}")
        pairs.append((key, node))
    return syntax.Record(tuple(pairs))


def shaped(df: DataFrame, v: Value) -> Result:
    """Rows of a value: columns of a record, records of an array, the event column of a VARIANT."""
    good, errors = split(df, v.err)
    if v.kind == "null":
        return Result(good.limit(0).select(), errors)
    if isinstance(v.type, T.StructType):
        t = storable(v.type)
        col = converted(v.col, v.type, t)
        if not len(t):
            return Result(good.where(v.col.isNotNull()).select(), errors)
        rows = good.where(v.col.isNotNull()) if nullable_record(v) else good
        return Result(rows.select(*[col.getField(f.name).alias(f.name) for f in t]), errors)
    if isinstance(v.type, T.MapType) or v.kind == "variant":
        col = v.col if v.kind == "variant" else converted(v.col, v.type, T.VariantType())
        rows = good.where(col.isNotNull() & ~F.is_variant_null(col)).select(col.alias(EVENT))
        shape = F.schema_of_variant(EVENT)
        lists = rows.where(shape.startswith("ARRAY")).select(F.explode(F.try_variant_get(F.col(EVENT), "$", "array<variant>")).alias(EVENT))
        return Result(rows.where(shape.startswith("OBJECT")).union(lists), errors)
    if v.kind == "array":
        inner = v.type.elementType
        if isinstance(inner, T.NullType):
            return Result(good.limit(0).select(), errors)
        if isinstance(inner, (T.StructType, T.VariantType)):
            t = storable(v.type)
            rows = good.select(F.explode(converted(v.col, v.type, t)).alias("r")).where(F.col("r").isNotNull())
            if isinstance(inner, T.VariantType):
                return Result(rows.select(F.col("r").alias(EVENT)), errors)
            return Result(rows.select(*[F.col("r").getField(f.name).alias(f.name) for f in t.elementType]), errors)
    bad = all_failed(good, f"the result is no record but {v.type.simpleString()}")
    return Result(bad.output, bad.errors if errors is None else bad.errors.unionByName(errors))


def nullable_record(v: Value) -> bool:
    """False for a plain record constructor, which never is null."""
    return not repr(v.col).startswith("Column<'struct(")


def keep(df: DataFrame, expression: str, *, functions=None) -> Result:
    """``filter``: rows for which the condition is true; a failure is a no."""
    condition, err = Compiler(df.schema, functions).predicate(syntax.parse(expression))
    return Result(df.where(condition if err is None else condition & err.isNull()))


def assertion(df: DataFrame, expression: str, *, functions=None) -> Result:
    """``assertion``: as ``filter``, but the rows that fail become errors."""
    v = expect(Compiler(df.schema, functions).compile(syntax.parse(expression)), "assertion", "boolean")
    holds = F.coalesce(v.col.cast(BOOL), F.lit(False))
    message = F.when(~holds, F.lit(f"assertion failed: {expression.strip()}"))
    good, errors = split(df, F.coalesce(v.err, message) if v.err is not None else message)
    return Result(good, errors)
