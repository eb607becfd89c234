"""Bounded samples of labelled documents, the one place where fitting sees fewer rows than there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text


def labelled_ids(labels: DataFrame, column: str, per_class: int) -> list[tuple[int, int]]:
    """About ``per_class`` (doc_id, label) of each class (all where there are fewer), chosen by hash, outside the held-out fold; repeated ids count once, with their largest label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return sorted((r[0], r[1]) for r in picked.collect())


def class_share(labels: DataFrame, column: str) -> float:
    """Share of label 1 over all labelled rows outside the held-out fold; 0.5 if there are none."""
    rows = labels.where(F.col(column).isin(0, 1) & ~held_out(F.col("doc_id").cast("long")))
    return rows.agg(F.coalesce(F.avg(F.col(column).cast("double")), F.lit(0.5))).first()[0]


def labelled_texts(docs: DataFrame, ids: list[tuple[int, int]]) -> DataFrame:
    """doc_id, text, label of the sampled ids: the sample, of bounded size, is broadcast; of repeated documents one text stays."""
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))
    return id_text(docs).join(picked, "doc_id").where("text is not null").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
