"""Helpers shared by the operators: shared scratch tables, byte-exact words and vectorised hashing."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; where that is unset, one under the warehouse, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rillflow_scratch"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_LEFT: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. What lies there serves lazy results, so it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/rillflow-{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    return path


@atexit.register
def _clean_up() -> None:
    """Local paths go directly, as the JVM may have ended already; others while it lives."""
    for path in _LEFT:
        if path.startswith("file:") or "://" not in path:
            shutil.rmtree(re.sub("^file:(//)?", "", path), ignore_errors=True)
        elif (spark := SparkSession.getActiveSession()) is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._rillflow_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables made by :func:`keep` that no later step reads."""
    for df in frames:
        path = getattr(df, "_rillflow_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            _LEFT.discard(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does so when their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage: they return the heap that a finished stage needed, which the next one's Python workers may need."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows that cross to Python at once: texts are long, so Spark's 10,000 would be too many
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the rows and bytes of the session's Arrow batches (never raising what the user set)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def id_text(docs: DataFrame) -> DataFrame:
    """Only the columns an operator reads; extra columns, whatever their names, take no part."""
    in_small_batches(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def held_out(doc_id) -> "F.Column":
    """True for rows that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Hasher(dict):
    """word -> 64-bit hash, remembering at most ``limit`` words at once."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def many(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order of position; with fewer words, one of the whole run; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    h = np.zeros(n - width + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = mix(h * MIX + words[k : n - width + 1 + k] + U64(k + 1))
    return h


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches of bounded length and, as rows may be large, bounded bytes (one row more at most)."""
    wide = [i for i, f in enumerate(schema) if pa.types.is_binary(f.type) or pa.types.is_string(f.type) or pa.types.is_list(f.type)]
    held: list[tuple] = []
    room = most_bytes
    for row in rows:
        held.append(row)
        for i in wide:
            if row[i] is not None:
                room -= len(row[i]) * (8 if isinstance(row[i], (list, np.ndarray)) else 1)
        if len(held) >= size or room <= 0:
            yield to_batch(held, schema)
            held, room = [], most_bytes
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


WORD_BYTES = 1 << 20  # of words and their places that come to the driver at once


def bit_array(cells: DataFrame, bits: int) -> np.ndarray:
    """The low ``bits`` of a column of hashes as a bit array, joined on the driver from words made by the tasks.

    The words are made at once in a few tasks a core and come to the driver in parts of about WORD_BYTES:
    a local iterator runs a job for each partition, one after the other.
    """
    sliced = cells.selectExpr(f"`{cells.columns[0]}` & {(1 << bits) - 1}L AS at").groupBy(F.expr("shiftright(at, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 AS int)))").alias("mask"))

    def dense(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at, mask = np.asarray(batch.column("word")).astype("<u4"), np.asarray(batch.column("mask")).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([mask.tobytes()], pa.binary())], names=["at", "mask"])

    out = np.zeros(1 << max(0, bits - 5), np.uint32)
    sliced = sliced.coalesce(2 * cells.sparkSession.sparkContext.defaultParallelism)
    made = keep(sliced.mapInArrow(dense, "at binary, mask binary"), "words")
    for row in made.coalesce(max(1, 2 * out.nbytes // WORD_BYTES)).toLocalIterator():
        out[np.frombuffer(row[0], "<u4")] |= np.frombuffer(row[1], "<u4")
    discard(made)
    return out


class BitTest:
    """Whether hashes are in a bit array; others may be too, which costs work but changes no result."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        at = cells & (len(self.words) * 32 - 1)
        return (self.words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0
