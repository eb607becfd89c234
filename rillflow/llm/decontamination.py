"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets (powers of two). A partition has its own sketch
table: each of its items gives a bottom-k MinHash sketch, its k least shingle hashes, k being just large
enough that a document which holds the wanted share of an item's shingles must hold one of the k (of n
shingles at least ``need`` are shared, so at most n - need are missing and k = n - need + 1 cannot all be).
A document is looked up in the partitions that its own size allows: not where even the smallest item needs
more shingles than it has. Sketching the short side and probing it with the long one is what keeps short
items findable inside very long documents. Every candidate is then verified by its exact shingle containment.
Shingles are compared by 64-bit hashes: n document and m item shingles have about n * m / 2**64 false meetings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitTest, Hasher, batches, id_text, in_small_batches, shingles

WORD = re.compile(r"[^\W_]+")
FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, item_shingles long, matched long, containment double"


def words_of(text: str | None) -> list[bytes]:
    return [w.encode() for w in WORD.findall(text.lower())] if text else []


class Partition:
    """The sketch table of the items of one size class."""

    def __init__(self, members: list[int], sets: list[np.ndarray], need: list[int]):
        self.least = min(need[i] for i in members)
        sketches = [sets[i][: len(sets[i]) - need[i] + 1] for i in members]
        hashes, owners = np.concatenate(sketches), np.repeat(members, [len(x) for x in sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]

    def candidates(self, near: np.ndarray) -> np.ndarray:
        """Items with one of the shingles in their sketch."""
        lo, hi = np.searchsorted(self.hashes, near, "left"), np.searchsorted(self.hashes, near, "right")
        return np.concatenate([self.owners[:0], *(self.owners[lo[i] : hi[i]] for i in np.flatnonzero(hi > lo))])


class ContainmentIndex:
    """Sketch tables by size and the whole shingle sets of one bounded block of items."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, threshold: float):
        hasher, self.width = Hasher(), width
        words = [words_of(text) for _, text in items]
        found = [np.unique(shingles(hasher.many(w), width)) for w in words]
        kept = [i for i, s in enumerate(found) if len(s)]
        self.item_ids = [items[i][0] for i in kept]
        self.sets = [found[i] for i in kept]
        self.need = [int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        #: lengths of items of fewer words than a shingle: their one shingle is sought at its own width
        self.short = sorted({len(words[i]) for i in kept if len(words[i]) < width})
        classes: dict[int, list[int]] = {}
        for at, s in enumerate(self.sets):
            classes.setdefault(len(s).bit_length(), []).append(at)
        self.partitions = [Partition(members, self.sets, self.need) for _, members in sorted(classes.items())]
        #: whether a sketch may have a hash, a bit each: every Python worker holds this
        there = np.zeros(1 << FILTER_BITS, bool)
        for p in self.partitions:
            there[(p.hashes & np.uint64(len(there) - 1)).astype(np.int64)] = True
        self.filter = BitTest(np.packbits(there, bitorder="little").view("<u4"))

    def shingles_of(self, hasher: Hasher, text: str | None) -> np.ndarray:
        """All shingles of a document, and its runs as short as the index's short items."""
        hashed = hasher.many(words_of(text))
        short = [shingles(hashed[i : i + n], self.width) for n in self.short for i in range(len(hashed) - n + 1)]
        return np.concatenate([shingles(hashed, self.width), *short])

    def matches(self, found: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item_id, item size, shingles shared) of each item that is contained; ``found`` are a document's shingles."""
        if not self.partitions or not len(found):
            return
        near = np.unique(found[self.filter(found)])
        if not len(near):
            return
        met = [p.candidates(near) for p in self.partitions if p.least <= len(found)]
        candidates = np.unique(np.concatenate([np.zeros(0, np.int64), *met]))
        if not len(candidates):
            return
        whole = np.unique(found)
        for at in candidates.tolist():
            own = self.sets[at]
            place = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            shared = int((whole[place] == own).sum())
            if shared >= self.need[at]:
                yield self.item_ids[at], len(own), shared


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str | None]]]:
    """Distinct items in blocks of bounded text, one block at a time on the driver."""
    held, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def contained_items(docs: DataFrame, items: DataFrame, *, width: int = 5, threshold: float = 0.8, block_chars: int = 16_000_000) -> DataFrame:
    """One row per (document, item) whose document holds at least ``threshold`` of the item's distinct word shingles.

    Words are runs of letters and digits, lower-cased. Items with fewer than ``width`` words count as
    one shingle of all their words; items or documents without words, and null texts, match nothing.
    Repeated items count once; repeated documents give repeated rows. Each block of items (at most
    ``block_chars`` characters) is broadcast and met by one pass over the documents.
    """
    spark = docs.sparkSession
    source = id_text(docs)
    out = None
    for block in item_blocks(items, block_chars):
        index = spark.sparkContext.broadcast(ContainmentIndex(block, width, threshold))

        def search(stream: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("matched", pa.int64()), ("containment", pa.float64())])
            hasher, own = Hasher(), index.value

            def rows():
                for batch in stream:
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                        for item_id, size, shared in own.matches(own.shingles_of(hasher, text)):
                            yield doc_id, item_id, size, shared, shared / size

            yield from batches(rows(), schema)

        part = source.mapInArrow(search, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, width: int = 5, threshold: float = 0.8, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item: no row moves, each block of items is one more sieve."""
    at = in_small_batches(docs).columns.index("text")
    for block in item_blocks(items, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(ContainmentIndex(block, width, threshold))

        def sieve(stream: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hasher, own = Hasher(), index.value
            for batch in stream:
                clean = [next(own.matches(own.shingles_of(hasher, t)), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(sieve, docs.schema)
    return docs
