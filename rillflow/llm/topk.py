"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

A vector is cut into equal segments; a segment is described by its mean and standard deviation.
For two vectors the squared distance is at least sum(m * ((mean - mean')^2 + (dev - dev')^2)) over
segments of m components, so their inner product, (|x|^2 + |q|^2 - d^2) / 2, is at most
sum(m * (mean * mean' + dev * dev')). Levels go from coarse to fine; only pairs whose bound reaches
the query's k-th best score so far get an exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

BLOCK = 1024
BLOCK_BYTES = 32 << 20


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: components as floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding")
    whole = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    good = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & good & (F.size(x) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def segment_features(x: np.ndarray, level: int) -> np.ndarray:
    """sqrt(m) * (mean, deviation) per segment at 2**level segments: a dot product of two such rows is the bound."""
    parts = np.array_split(x, min(1 << level, x.shape[1]), axis=1)
    cols = [f(p, axis=1) * np.sqrt(p.shape[1]) for p in parts for f in (np.mean, np.std)]
    return np.stack(cols, axis=1)


def merge(ids, scores, rows, new_ids, new_scores, k):
    """Running best lists (queries x k, padded by id -1) with further (query row, id, score) triples."""
    touched = np.unique(rows)
    old_rows = np.repeat(touched, k)
    all_rows = np.concatenate([old_rows, rows])
    all_ids = np.concatenate([ids[touched].ravel(), new_ids])
    all_scores = np.concatenate([scores[touched].ravel(), new_scores])
    real = all_ids != np.iinfo(np.int64).max
    all_rows, all_ids, all_scores = all_rows[real], all_ids[real], all_scores[real]
    order = np.lexsort((all_ids, -all_scores, all_rows))
    all_rows, all_ids, all_scores = all_rows[order], all_ids[order], all_scores[order]
    first = np.searchsorted(all_rows, all_rows, "left")
    rank = np.arange(len(all_rows)) - first
    best = rank < k
    ids[touched], scores[touched] = np.iinfo(np.int64).max, -np.inf
    ids[all_rows[best], rank[best]] = all_ids[best]
    scores[all_rows[best], rank[best]] = all_scores[best]


class Best:
    """The k best (ids, scores) of each query over blocks of candidates, which are seen once and not held."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, levels: tuple[int, ...]):
        self.qids, self.q, self.k = qids, q, k
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(q), k), -np.inf)
        self.levels = tuple(lv for lv in levels if (1 << lv) < q.shape[1])
        self.features = [segment_features(q, lv) for lv in self.levels]
        self.norm = np.sqrt((q * q).sum(1))
        #: pairs that came to each level, and to exact scores
        self.met = [0] * (len(self.levels) + 1)

    def add(self, cid: np.ndarray, x: np.ndarray) -> None:
        q, k = self.q, self.k
        slack = 1e-9 * np.outer(np.sqrt((x * x).sum(1)), self.norm) + 1e-6
        alive = cid[:, None] != self.qids[None, :]
        threshold = self.scores[:, k - 1]
        for i, (lv, fq) in enumerate(zip(self.levels, self.features)):
            if not np.isfinite(threshold).any() or not alive.any():
                break
            self.met[i] += int(alive.sum())
            alive &= segment_features(x, lv) @ fq.T + slack >= threshold[None, :]
        n = int(alive.sum())
        self.met[-1] += n
        if n == 0:
            return
        if n * 8 > alive.size:
            exact = np.where(alive, x @ q.T, -np.inf)
            if len(x) > k:
                reach = np.partition(exact, len(x) - k, axis=0)[len(x) - k]
                alive &= exact >= np.maximum(reach, threshold)[None, :]
            r, c = np.nonzero(alive)
            s = exact[r, c]
        else:
            r, c = np.nonzero(alive)
            s = np.concatenate([np.einsum("ij,ij->i", x[r[a : a + 65536]], q[c[a : a + 65536]]) for a in range(0, len(r), 65536)])
        merge(self.ids, self.scores, c, cid[r], s, k)

    def rows(self) -> list[tuple[int, int, int]]:
        r, c = np.nonzero(np.isfinite(self.scores))
        return list(zip(self.qids[r].tolist(), self.ids[r, c].tolist(), self.scores[r, c].astype(np.int64).tolist()))


class BigBest:
    """As Best for components beyond exact doubles, by Python's whole numbers; scores are clamped to a long."""

    def __init__(self, qids: np.ndarray, q: list[list], k: int):
        self.qids, self.k = qids.tolist(), k
        self.q = [[int(e) for e in v] for v in q]
        self.best: list[list[tuple[int, int]]] = [[] for _ in q]

    def add(self, cid: np.ndarray, x: np.ndarray) -> None:
        whole = [(i, [int(e) for e in v]) for i, v in zip(cid.tolist(), x.tolist())]
        for at, (qid, q) in enumerate(zip(self.qids, self.q)):
            found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, q)))), i) for i, v in whole if i != qid]
            self.best[at] = sorted([*self.best[at], *found])[: self.k]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(qid, i, -s) for qid, found in zip(self.qids, self.best) for s, i in found]


class Search:
    """Both ways for the queries of one length: a candidate block goes to the exact doubles where these hold."""

    def __init__(self, queries: list[tuple[int, list]], k: int, levels: tuple[int, ...]):
        qids, q = np.array([i for i, _ in queries]), np.array([v for _, v in queries], float)
        self.most = float(np.abs(q).max(initial=0))
        self.small, self.big = Best(qids, q, k, levels), None
        self.make = lambda: BigBest(qids, [v for _, v in queries], k)

    def add(self, cid: np.ndarray, x: np.ndarray) -> None:
        # products and their sum are whole numbers below 2**53
        if self.most * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**53:
            self.small.add(cid, x)
        else:
            self.big = self.big or self.make()
            self.big.add(cid, x)

    def rows(self) -> list[tuple[int, int, int]]:
        return self.small.rows() + (self.big.rows() if self.big else [])


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, query_block: int = 16_384, levels: tuple[int, ...] = (2, 4)) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products, ties to the smaller vec_id.

    The query set meets all candidates in blocks of about ``query_block`` queries, fewer where they would pass
    BLOCK_BYTES; only a block is ever broadcast, and candidates stream past it. A candidate with the query's id is the query itself; a candidate of another length is
    no candidate. Of rows that repeat a query's id one vector (the smallest) asks; repeated candidates
    each count. With fewer candidates all are returned; without queries the result is empty.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    asked = keep(quantised(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    total, longest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    candidates = quantised(vectors, scale)
    out = None
    n_blocks = max(-(-total // query_block), -(-total * longest * 8 // BLOCK_BYTES))
    for at in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == at).orderBy("vec_id").collect()
        block = spark.sparkContext.broadcast([(r[0], list(r[1])) for r in rows])

        def search(stream: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, list] = {}
            for qid, v in block.value:
                by_dim.setdefault(len(v), []).append((qid, v))
            searches = {d: Search(found, k, levels) for d, found in by_dim.items()}
            for batch in stream:
                lists = batch.column("v")
                flat, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
                offsets = offsets - offsets[0]
                ids, sizes = np.asarray(batch.column("vec_id")), np.diff(offsets)
                for d, own in searches.items():
                    pick = np.nonzero(sizes == d)[0]
                    for a in range(0, len(pick), BLOCK):
                        part = pick[a : a + BLOCK]
                        own.add(ids[part], flat[offsets[part][:, None] + np.arange(d)])
            for own in searches.values():
                columns = list(zip(*own.rows())) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=("query_id", "vec_id", "score"))

        part = candidates.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
