"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``. ``run`` writes every stage's result to the shared folder
and reads it back, so a lost executor never costs more than the stage at hand. All but the first
start by having the executors give back the heap that the stage before it needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import decontamination, jaccard, packing, pii, toxicity
from rillflow.llm.common import give_back, keep, table
from rillflow.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go; rows without a text stay."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a 5-word shingle Jaccard of 0.8 or more, the smallest doc_id stays."""
    give_back(spark)
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles go."""
    give_back(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every document stays."""
    give_back(spark)
    return pii.redact(docs, pii.fit_pii())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048, one row a piece."""
    give_back(spark)
    return packing.pack(docs, tokenizer_path(), length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: Fitted scores, decoded labels and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
