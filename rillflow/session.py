"""The session that pipelines expect: UTC, adaptive plans, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "rillflow", **settings: str) -> SparkSession:
    """A session with the settings that results depend on; master and sizes come from the caller or spark-submit."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
