"""What a node of a pipeline yields: its events, and the events that failed there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR_SCHEMA = "event string, errorMessage string"


@dataclass(frozen=True)
class Result:
    output: DataFrame
    errors: DataFrame | None = None


def event_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]), {"ignoreNullFields": "false"}) if df.columns else F.lit("{}")


def split(df: DataFrame, err: Column | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows that went well, failed rows as event and errorMessage)."""
    if err is None:
        return df, None
    failed = df.where(err.isNotNull()).select(event_json(df).alias("event"), err.alias("errorMessage"))
    return df.where(err.isNull()), failed


def all_failed(df: DataFrame, message: str) -> Result:
    errors = df.select(event_json(df).alias("event"), F.lit(message).alias("errorMessage"))
    return Result(df.sparkSession.createDataFrame([], T.StructType([])), errors)
