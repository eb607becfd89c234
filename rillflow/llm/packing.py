"""Sequence packing along a space-filling curve.

A document's token ids are hashed into a small count vector, projected to a few dimensions and
quantised; the Hilbert index of that cell is its key. Documents are range-sorted by key, so that
neighbours on the curve share sequences, and their ids are cut into full sequences. Ranges hold about
equally many ids, not documents: ids are summed over stretches of the curve first.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, keep

DIMS, BITS, BUCKETS = 4, 8, 1024
STRETCH_BITS = 14


def token_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """ids as the vocabulary file's own library gives them.

    A byte-level BPE of the tokenizers library has a twin in ranks form beside it, ``*.tiktoken``, that
    yields the same ids about five times as fast; texts that spell a special token go to the first.
    """
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(path)
    with open(path, "rb") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    plain = lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    try:
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, FileNotFoundError):
        return plain
    return lambda texts: [plain([t])[0] if any(x in t for x in special) else fast.encode_ordinary(t) for t in texts]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates: Skilling's transform, then the bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def curve_keys(id_lists: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed, projected and squashed count vector."""
    plane, points = projection(), np.zeros((len(id_lists), DIMS))
    for i, ids in enumerate(id_lists):
        counts = np.bincount((ids.astype(np.int64) * 2654435761 >> 7) % BUCKETS, minlength=BUCKETS)
        v = np.sqrt(counts)
        points[i] = v @ plane / max(np.sqrt(v @ v), 1e-9)
    cells = np.clip((0.5 + 0.5 * np.tanh(points)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells, BITS)


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, key, n, ids: ids as little-endian uint16 (uint32 if the vocabulary needs it), the end id last."""

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

        def rows():
            for batch in stream:
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for a in range(0, len(texts), 256):
                    arrays = [np.array([*ids, end_id], "<u4") for ids in encoder([t or "" for t in texts[a : a + 256]])]
                    for doc_id, ids, key in zip(doc_ids[a : a + 256], arrays, curve_keys(arrays).tolist()):
                        yield doc_id, key, len(ids), (ids.astype("<u2") if ids.max() < 65536 else ids).tobytes()

        yield from batches(rows(), schema, 2000)

    return id_text(docs).mapInArrow(encode, "doc_id long, key long, n long, ids binary")


def stretches(ids: DataFrame, most_ids: int) -> tuple[DataFrame, int]:
    """``ids`` with ``part``, numbered along the curve: parts of about ``most_ids`` ids (a document is never split), and the number of parts.

    The sums of 2**STRETCH_BITS stretches of the curve, a bounded number, come to the driver. Light neighbours
    share a part; a heavy stretch is dealt to several by a hash of the document, so no key can overfill one.
    """
    at = F.shiftright("key", DIMS * BITS - STRETCH_BITS)
    sums = sorted((r[0], r[1]) for r in ids.groupBy(at.alias("at")).agg(F.sum("n")).collect())
    rows, part, room = [], -1, 0
    for place, n in sums:
        pieces = -(-n // most_ids)
        if pieces > 1 or n > room:
            part, room = part + 1, most_ids
        rows.append((place, part, pieces))
        part, room = (part + pieces - 1, 0) if pieces > 1 else (part, room - n)
    plan = F.broadcast(ids.sparkSession.createDataFrame(rows, "at long, first int, pieces long"))
    spread = F.pmod(F.xxhash64("doc_id", "key"), F.col("pieces")).cast("int")
    return ids.withColumn("at", at).join(plan, "at").select("doc_id", "key", "n", "ids", (F.col("first") + spread).alias("part")), part + 1


def binary_parts(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_stream(documents: Iterator[tuple[int, np.ndarray]], length: int, first: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """Pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset).

    All sequences are full but the last run, which is cut at powers of two: no id is padding.
    """
    sequence, fill, held = first, 0, []
    for doc_id, ids in documents:
        start = 0
        while start < len(ids):
            n = min(length - fill, len(ids) - start)
            held.append((doc_id, start, ids[start : start + n], len(ids)))
            start, fill = start + n, fill + n
            if fill == length:
                yield from lay(held, [length], sequence)
                sequence, fill, held = sequence + 1, 0, []
    if held:
        yield from lay(held, binary_parts(fill), sequence)


def lay(held: list, sizes: list[int], sequence: int) -> Iterator[tuple]:
    """Lays held pieces end to end into sequences of the given sizes, cutting where one ends."""
    sizes = list(sizes)
    offset = 0
    for doc_id, start, ids, total in held:
        while len(ids):
            n = min(sizes[0] - offset, len(ids))
            crc = zlib.crc32(ids[:n].astype("<u4").tobytes()) & 0xFFFFFFFF
            yield doc_id, start, n, crc, total, sequence, offset
            start, ids, offset = start + n, ids[n:], offset + n
            if offset == sizes[0]:
                sizes.pop(0)
                sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = 1, partition_bytes: int = 24_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; very long texts span sequences; repeated rows (also of a
    null doc_id) are packed each; an empty table gives no rows. ``length`` must be a power of two.
    Documents are tokenised once, into a table in the shared folder, which is then dealt along the curve into
    parts of about ``partition_bytes`` (two bytes an id) and sorted there by (key, doc_id).
    """
    spark = docs.sparkSession
    ids = keep(tokenised(docs, tokenizer_path, end_id), "tokens")
    dealt, parts = stretches(ids, max(1, partition_bytes // 2))
    ordered = dealt.repartitionById(max(1, parts), F.col("part")).sortWithinPartitions("part", "key", "doc_id", "ids").drop("part")

    def fill(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def documents():
            for batch in stream:
                for doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                    yield doc_id, np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")

        yield from batches(pack_stream(documents(), length, TaskContext.get().partitionId() << 40), schema)

    return ordered.mapInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
