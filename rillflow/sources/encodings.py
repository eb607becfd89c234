"""Encodings of files and messages: CSV, JSON_OBJECT, JSON_ARRAY, JSON_OBJECT_LINE, STRING_LINE, TEXT, XML, PARQUET."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiler import EVENT, quoted
from ..functions.syntax import ExpressionError

RAW = "__raw__"
DECODED = ("CSV", "JSON_OBJECT", "JSON_ARRAY", "JSON_OBJECT_LINE", "STRING_LINE", "TEXT", "XML")


def read_files(spark: SparkSession, path, encoding: str, *, schema: T.StructType | str | None = None, streaming: bool = False, options: dict | None = None) -> DataFrame:
    """Events of files; gzip is recognised by name. JSON that is no object fails the read unless ``columnNameOfCorruptRecord`` is in the schema."""
    reader = (spark.readStream if streaming else spark.read).options(**(options or {}))
    encoding = encoding.upper()
    if schema is not None:
        reader = reader.schema(schema)
    if encoding == "CSV":
        df = reader.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
        return df
    if encoding in ("JSON_OBJECT", "JSON_ARRAY"):
        return reader.option("multiLine", True).option("mode", "FAILFAST" if schema is None else "PERMISSIVE").json(path)
    if encoding == "JSON_OBJECT_LINE":
        corrupt = schema is not None and "_corrupt_record" in str(schema)
        return reader.option("mode", "PERMISSIVE" if corrupt else "FAILFAST").json(path)
    if encoding in ("STRING_LINE", "TEXT"):
        return reader.text(path, wholetext=encoding == "TEXT").withColumnRenamed("value", RAW)
    if encoding == "XML":
        if not (options or {}).get("rowTag"):
            raise ExpressionError("XML files need options.rowTag, the element that is one event")
        df = reader.option("attributePrefix", "").option("inferSchema", False).xml(path)
        return df
    if encoding == "PARQUET":
        return reader.parquet(path)
    raise ExpressionError(f"unknown encoding {encoding}")


def decode(df: DataFrame, column: str, encoding: str, *, schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and bad messages of a text column. Without a schema JSON events are one VARIANT column."""
    encoding, text = encoding.upper(), F.col(quoted(column)).cast("string")
    bad = lambda cond: df.where(cond).select(text.alias("event"), F.lit(f"can't read as {encoding}").alias("errorMessage"))
    none = df.sparkSession.createDataFrame([], "event string, errorMessage string")
    if encoding in ("TEXT",):
        return df.select(text.alias(RAW)), none
    if encoding == "STRING_LINE":
        return df.select(F.explode(F.split(text, "\r?\n")).alias(RAW)).where(F.col(RAW) != ""), none
    if encoding in ("JSON_OBJECT", "JSON_OBJECT_LINE", "JSON_ARRAY"):
        lines = df.select(F.explode(F.split(text, "\r?\n")).alias("_text")).where("trim(_text) <> ''") if encoding == "JSON_OBJECT_LINE" else df.select(text.alias("_text"))
        parsed = lines.withColumn("_v", F.try_parse_json("_text"))
        broken = parsed.where("_v is null").select(F.col("_text").alias("event"), F.lit(f"can't read as {encoding}").alias("errorMessage"))
        rows = parsed.where("_v is not null")
        rows = rows.select(F.explode(F.try_variant_get("_v", "$", "array<variant>")).alias("_v")) if encoding == "JSON_ARRAY" else rows.select("_v")
        if schema is None:
            return rows.select(F.col("_v").alias(EVENT)), broken
        t = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return rows.select(F.from_json(F.to_json("_v"), t).alias("r")).select("r.*"), broken
    if encoding == "XML":
        if schema is None:
            raise ExpressionError("XML messages need a schema")
        row = F.from_xml(text, schema if isinstance(schema, str) else schema.simpleString(), {"attributePrefix": ""})
        return df.select(row.alias("r")).where("r is not null").select("r.*"), bad(row.isNull())
    if encoding == "CSV":
        if schema is None:
            raise ExpressionError("CSV messages need a schema: a message has its header in its first line")
        t = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        lines = df.select(F.posexplode(F.split(text, "\r?\n")).alias("_at", "_text")).where("_at > 0 and trim(_text) <> ''")
        return lines.select(F.from_csv("_text", t.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("r")).select("r.*"), none
    raise ExpressionError(f"unknown encoding {encoding}")


def record(df: DataFrame) -> Column:
    if len(df.schema) == 1 and isinstance(df.schema[0].dataType, T.VariantType) and df.columns == [EVENT]:
        return F.to_json(F.col(EVENT))
    return F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"})


def encode(df: DataFrame, encoding: str) -> DataFrame:
    """``value``: one text per event (JSON_OBJECT, JSON_OBJECT_LINE, CSV rows) or, for JSON_ARRAY, per task."""
    encoding = encoding.upper()
    if encoding in ("JSON_OBJECT", "JSON_OBJECT_LINE"):
        return df.select(record(df).alias("value"))
    if encoding == "CSV":
        cells = F.struct(*[F.col(quoted(c)).cast("string").alias(c) for c in df.columns])
        return df.select(F.to_csv(cells).alias("value"))
    if encoding == "JSON_ARRAY":
        one = df.select(record(df).alias("value"), F.spark_partition_id().alias("p"))
        return one.groupBy("p").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value")
    if encoding in ("STRING_LINE", "TEXT"):
        return df.select(F.col(quoted(RAW)).alias("value"))
    raise ExpressionError(f"unknown encoding {encoding}")


def write_files(df: DataFrame, path: str, encoding: str, *, mode: str = "append", options: dict | None = None, partition_by: list[str] | None = None) -> None:
    encoding = encoding.upper()
    writer = df.write.mode(mode).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if encoding == "PARQUET":
        writer.parquet(path)
    elif encoding == "CSV":
        writer.option("header", True).csv(path)
    elif encoding in ("JSON_OBJECT", "JSON_OBJECT_LINE"):
        writer.option("ignoreNullFields", False).json(path)
    else:
        encode(df, encoding).write.mode(mode).text(path)
