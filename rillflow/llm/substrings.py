"""Removal of repeated passages with a count-min prefilter.

First pass: each task sketches its documents' windows, and the sketches are merged by sums; a window's
estimate, the minimum over the sketch's rows, is never below its count. Second pass: only windows estimated
to repeat are grouped exactly.

The sketch has ROWS rows of 2**b counters, b by the size of the corpus, each row with its own hash. It does
not count all windows but their anchors: of the runs of ANCHOR words inside a window the one of least hash.
Equal windows have equal anchors at equal places, so two occurrences of a window are two occurrences of its
anchor: the anchor's estimate is never below the window's count, while a document has an anchor only every
few words. Counters saturate at two, all that the second pass asks for. A task's sketch is kept sparse, as
(row and column, count), so it is never larger than its part of the corpus; merged, the columns that reach
two are a bit array of ROWS * 2**b bits, whose size is checked. Where the corpus asks for more than that,
columns are not folded to 2**b but to 2**WIDE_BITS, and each document gets its own repeated ones by a join.

Windows are grouped by 96 bits of hash, over words of 64: among N distinct repeated windows about N**2 / 2**97
pairs may be taken for equal, and among V distinct words V**2 / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, U64, BitTest, Hasher, batches, binary_column, bit_array, discard, id_text, keep, mix

ANCHOR = 8
ROWS, WIDE_BITS = 2, 40
BYTES_A_COLUMN = 12  # of text, about a quarter of an anchor: so sparse are the rows
CHUNK_WORDS = 400_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, joined from runs of powers of two."""
    out, at, power, size = None, 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if out is None:
                    out = power
                else:
                    n = len(power) - at
                    out = mix(out[:n] * MIX + power[at : at + n] + U64(at)) if n > 0 else power[:0]
                at += size
            size *= 2
            if size > width:
                return out
            power = mix(power[: len(power) - size // 2] * MIX + power[size // 2 :] + U64(size)) if len(power) > size // 2 else power[:0]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum (``pick``) of each ``width`` neighbours, by doubling."""
    size, out = 1, values
    while size * 2 <= width:
        out = pick(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    rest = width - size
    return pick(out[:-rest], out[rest:]) if rest and len(out) > rest else out[:0] if rest else out


class Chunk:
    """Neighbouring documents laid end to end: their words' hashes, windows and windows' anchors."""

    def __init__(self, hasher: Hasher, texts: list[bytes | None], width: int, bits: int):
        self.bits = bits
        self.words = [t.split() if t else [] for t in texts]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = hasher.many([w for ws in self.words for w in ws])
        self.width, n = width, len(flat)
        count = max(0, n - width + 1)
        owner_end = np.repeat(self.starts[1:], lengths)
        #: window i lies in one document
        self.whole = np.arange(count) + width <= owner_end[:count]
        grams = runs(flat, min(ANCHOR, width))
        span = width - min(ANCHOR, width) + 1
        self.anchor = sliding(grams, span, np.minimum)[:count]
        self.grams, self.span, self.flat = grams, span, flat

    def cells(self) -> np.ndarray:
        """The counters of all anchors, in each row, once for each place."""
        if not self.whole.any():
            return np.zeros(0, np.int64)
        own = np.where(self.whole, self.anchor, U64(0))
        edge = np.zeros(self.span - 1, U64)
        most = sliding(np.concatenate([edge, own, edge]), self.span, np.maximum)
        found = self.grams[(most == self.grams[: len(most)]) & (most > 0)]
        return np.concatenate([cell_of(found, r, self.bits) for r in range(ROWS)])

    def windows(self, reaches_two) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, hashes, second hashes) of the windows whose estimate, the least counter of their anchor over the rows, is two or more."""
        at = np.nonzero(self.whole)[0]
        for r in range(ROWS):
            at = at[reaches_two(cell_of(self.anchor[at], r, self.bits))] if len(at) else at
        if not len(at):
            return at, np.zeros(0, U64), np.zeros(0, np.int32)
        with np.errstate(over="ignore"):
            second = runs(mix(self.flat * MIX + U64(7)), self.width)[at]
        return at, runs(self.flat, self.width)[at], (second >> U64(32)).astype(np.uint32).view(np.int32)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def cell_of(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each run in a row of 2**bits: row and column as one number."""
    with np.errstate(over="ignore"):
        mixed = mix(grams + U64(row) * MIX) if row else grams
    return (mixed >> U64(64 - bits)).astype(np.int64) | (row << bits)


def chunked(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK_WORDS words (a longer document is alone)."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < CHUNK_WORDS * 6):
            size += len(texts[b] or b"")
            b += 1
        yield a, b
        a = b


def with_row_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text and what orders documents: ``rid``, a null doc_id coming first, and ``tid``, which tells differing texts of one doc_id apart (zero where there are none)."""
    source = id_text(docs).withColumn("rid", F.coalesce("doc_id", F.lit(-(2**63))))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    if source.select("rid", text.alias("t")).groupBy("rid").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").limit(1).count():
        return source.withColumn("tid", text)
    return source.withColumn("tid", F.lit(0).cast("long"))


def repeated_cells(source: DataFrame, width: int, bits: int) -> DataFrame:
    """Counters whose merged count reaches two: one row each."""

    def sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in stream:
            texts = binary_column(batch, "text")
            for a, b in chunked(texts):
                cells, n = np.unique(Chunk(hasher, texts[a:b], width, bits).cells(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.minimum(n, 2).astype(np.int64))], names=["cell", "n"])

    sketches = source.select("text").mapInArrow(sketch, "cell long, n long")
    return sketches.groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 2").select("cell")


def own_cells(source: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """rid, tid, own: the repeated counters of each document that has any, as sorted longs."""

    def anchors(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in stream:
            for rid, tid, text in zip(batch.column("rid").to_pylist(), batch.column("tid").to_pylist(), binary_column(batch, "text")):
                found = np.unique(Chunk(hasher, [text], width, WIDE_BITS).cells())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rid, np.int64)), pa.array(np.full(len(found), tid, np.int64)), pa.array(found)], names=["rid", "tid", "cell"])

    met = source.select("rid", "tid", "text").mapInArrow(anchors, "rid long, tid long, cell long").join(cells, "cell", "left_semi")
    return met.groupBy("rid", "tid").agg(F.array_sort(F.collect_set("cell")).alias("own"))


def remove_repeats(docs: DataFrame, *, width: int = 20, max_bits: int = 28, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (and ``kept``, the text that stays, with ``texts``).

    A word goes if a window of ``width`` words of its document covers it whose word sequence also starts
    earlier: in a smaller doc_id, or earlier in the same document. Words are runs of bytes other than
    space and \\t to \\r. Null texts have no words; documents of fewer than ``width`` words lose none.
    Rows that repeat a doc_id with the same text count as one document and each get its result; differing
    texts of one doc_id are documents of their own, ordered by a hash of the text. Null ids come first.
    A row of the sketch has 2**b counters, b at most ``max_bits``; for a larger corpus documents get their
    repeated counters, of 2**WIDE_BITS, by a join.
    """
    spark = docs.sparkSession
    source = with_row_ids(docs)
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(16, (size // BYTES_A_COLUMN).bit_length())
    wide = bits > max_bits
    bits = WIDE_BITS if wide else bits
    cells = keep(repeated_cells(source, width, bits), "cells")
    shared, given = None, source.withColumn("own", F.lit(None).cast("array<long>"))
    if not wide:
        shared = spark.sparkContext.broadcast(BitTest(bit_array(cells, bits + (ROWS - 1).bit_length())))
    else:
        given = source.join(keep(own_cells(source, cells, width), "own"), ["rid", "tid"], "left")

    def estimate(own):
        """The test of a chunk's cells: the shared bits, or the one document's own cells."""
        if shared is not None:
            return shared.value
        own = np.array(own or [], np.int64)
        return lambda c: own[np.minimum(np.searchsorted(own, c), len(own) - 1)] == c if len(own) else np.zeros(len(c), bool)

    def ranges(texts, own):
        return chunked(texts) if shared is not None else ((i, i + 1) for i in range(len(texts)))

    def emit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in stream:
            bodies, own = binary_column(batch, "text"), batch.column("own").to_pylist()
            rids, tids = (np.asarray(batch.column(c)) for c in ("rid", "tid"))
            for a, b in ranges(bodies, own):
                chunk = Chunk(hasher, bodies[a:b], width, bits)
                at, hashes, second = chunk.windows(estimate(own[a]))
                owner = chunk.owners(at)
                columns = hashes.view(np.int64), second, rids[a:b][owner], tids[a:b][owner], (at - chunk.starts[owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["window", "second", "rid", "tid", "at"])

    windows = given.select("rid", "tid", "text", "own").mapInArrow(emit, "window long, second int, rid long, tid long, at int")
    first = windows.groupBy("window", "second").agg(F.min(F.struct("rid", "tid", "at")).alias("first"))
    kept_at = keep(first.groupBy(F.col("first.rid").alias("rid"), F.col("first.tid").alias("tid")).agg(F.collect_list("first.at").alias("firsts")), "firsts")

    def finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        schema = pa.schema(fields + ([("kept", pa.string())] if texts else []))

        def rows():
            for batch in stream:
                ids, bodies, own, firsts = batch.column("doc_id").to_pylist(), binary_column(batch, "text"), batch.column("own").to_pylist(), batch.column("firsts")
                for a, b in ranges(bodies, own):
                    chunk = Chunk(hasher, bodies[a:b], width, bits)
                    at, _, _ = chunk.windows(estimate(own[a]))
                    gone = np.zeros(len(chunk.flat) + 1, np.int64)
                    first = np.zeros(len(chunk.flat) + 1, bool)
                    for i in range(a, b):
                        if firsts[i].is_valid:
                            first[chunk.starts[i - a] + np.asarray(firsts[i].values)] = True
                    later = at[~first[at]]
                    np.add.at(gone, later, 1)
                    np.add.at(gone, later + width, -1)
                    covered = np.cumsum(gone)[:-1] > 0
                    for i in range(a, b):
                        words, cut = chunk.words[i - a], covered[chunk.starts[i - a] : chunk.starts[i - a + 1]]
                        stay = [w for w, c in zip(words, cut.tolist()) if not c] if cut.any() else words
                        body = b" ".join(stay)
                        out = ids[i], len(words), len(words) - len(stay), hashlib.sha256(body).hexdigest()
                        yield (*out, body.decode()) if texts else out

        yield from batches(rows(), schema, 2000)

    out = given.join(kept_at, ["rid", "tid"], "left").select("doc_id", "text", "own", "firsts").mapInArrow(finish, SCHEMA + (", kept string" if texts else ""))
    discard(cells)
    return out
