"""Avro schemas in sink settings as Spark schemas, and events fitted to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiler import quoted
from ..functions.syntax import ExpressionError

PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "enum": T.StringType(), "null": T.NullType()}


def spark_type(schema) -> T.DataType:
    """The Spark type of an Avro schema: unions with null are the other type, logical types are honoured."""
    if isinstance(schema, list):
        real = [s for s in schema if s != "null"]
        if len(real) != 1:
            raise ExpressionError("only unions of null and one type are supported")
        return spark_type(real[0])
    if isinstance(schema, str):
        if schema not in PLAIN:
            raise ExpressionError(f"unknown Avro type {schema}")
        return PLAIN[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    if logical == "date":
        return T.DateType()
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"]), nullable(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    if kind == "fixed":
        return T.BinaryType()
    return spark_type(kind)


def nullable(schema) -> bool:
    return isinstance(schema, list) and "null" in schema


def fitted(df: DataFrame, schema: dict) -> DataFrame:
    """Columns of the schema in its order: absent ones are null, whole numbers become times where asked, others are cast."""
    columns = []
    for f in spark_type(schema):
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c, have = F.col(quoted(f.name)), df.schema[f.name].dataType
        if isinstance(f.dataType, T.TimestampType) and isinstance(have, T.IntegralType):
            c = F.timestamp_millis(c.cast("long"))
        elif isinstance(f.dataType, T.DateType) and isinstance(have, T.IntegralType):
            c = F.date_from_unix_date(c.cast("int"))
        columns.append(c.cast(f.dataType).alias(f.name))
    return df.select(*columns)
