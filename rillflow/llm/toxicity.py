"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text is first searched by its telling terms: those words, beginnings of words (so that inflected
forms meet) and repetitions whose presence correlates best with the label in the labelled examples (a
share of all such terms, no absolute count). The examples' unit vectors are held as postings in blocks
with each term's largest weight per block. A query visits blocks in falling order of their upper bound
and stops when the bound can no longer reach the k-th best cosine, so the neighbours are exact. A text
without a telling term is searched by all of its words against all words of the examples, exactly too.
Document frequencies are counted over the whole corpus. The neighbours' votes, weighted by closeness,
are calibrated on leave-one-out votes of the examples that are searched the same way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, batches, held_out, id_text, in_small_batches, mix, shingles
from .sampling import class_share, labelled_ids, labelled_texts

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, terms array<string>"
BLOCK = 32
STEMS = range(4, 9)


def forms(word: str) -> list[str]:
    """The word and its proper beginnings, the latter marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if n <= len(word))]


#: least number of times in a text, and the mark of the term for it (no letter, so never part of a word)
REPEATS = ((2, "\u00d72"), (4, "\u00d74"))


def all_terms(text: str) -> set[str]:
    """Every term of a text: forms of its words, and forms that stand at least twice or four times."""
    counts: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in forms(word):
            counts[f] += n
    return counts.keys() | {f"{f}{mark}" for f, n in counts.items() for least, mark in REPEATS if n >= least}


def words_in(text: str | None) -> Counter:
    """How often each word stands in the text."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


class TermFinder:
    """Numbers of a text's terms in a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = vocabulary
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        # repetitions may be in the vocabulary where the term itself is not
        self.bare = {t[: -len(mark)] for t in vocabulary for _, mark in REPEATS if t.endswith(mark)}
        self.plain = not self.bare and not any(t.endswith("*") for t in vocabulary)
        #: beginnings of the words that can have a form in the vocabulary
        self.heads = {t[: STEMS[0]] for t in (*vocabulary, *self.bare)} | {t[:-1] for t in (*vocabulary, *self.bare) if t.endswith("*") and len(t) <= STEMS[0]}

    def __reduce__(self):
        return TermFinder, (self.vocabulary,)

    def count(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms of a text with these words, rising, and how often each stands in it."""
        ids = self.ids
        if self.plain:
            counts = {ids[w]: words[w] for w in words.keys() & ids.keys()}
        else:
            seen: dict[str, int] = {}
            heads, size = self.heads, STEMS[0]
            for w, n in words.items():
                if w[:size] in heads:
                    for f in forms(w):
                        if f in ids or f in self.bare:
                            seen[f] = seen.get(f, 0) + n
            counts = {ids[f]: n for f, n in seen.items() if f in ids}
            if self.bare:
                counts |= {ids[f + mark]: n for f, n in seen.items() for least, mark in REPEATS if n >= least and f + mark in ids}
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, n = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(found)
        return found[order], n[order]


def near_copy_marks(hasher: Hasher, text: str, slots: int = 8) -> list[int]:
    """Minima of differently mixed hashes of the word triples: equal in most slots for near copies."""
    grams = shingles(hasher.many([w.encode() for w in WORD.findall(text.lower())]), 3)
    return [int(mix(grams + U64(seed)).min()) for seed in range(slots)] if len(grams) else [0] * slots


Vector = tuple[np.ndarray, np.ndarray]


def as_arrays(v: dict[int, float] | Vector) -> Vector:
    """Terms, rising, and their weights."""
    return (np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)], np.float64)) if isinstance(v, dict) else v


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of lo[0]..hi[0]-1, lo[1]..hi[1]-1, and so on."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class BlockMaxIndex:
    """Unit TF-IDF vectors of the examples as postings by term and block, with each term's maximum per block."""

    def __init__(self, vectors: list[dict[int, float] | Vector], n_terms: int):
        vectors = [as_arrays(v) for v in vectors]
        order = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), i))
        self.rows = np.array(order, np.int64)  # neighbours on the same leading term share blocks
        self.blocks = -(-len(order) // BLOCK)
        if not order:
            return
        terms, weights = (np.concatenate([vectors[i][c] for i in order]) for c in (0, 1))
        at = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])
        by = np.lexsort((at, terms))
        terms, self.at, self.weights = terms[by], at[by], weights[by]
        # a cell is a term's postings in one block: they lie side by side
        block = self.at // BLOCK
        first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])
        self.block, self.maxima = block[first], np.maximum.reduceat(self.weights, first)
        self.cells = np.searchsorted(terms[first], np.arange(n_terms + 1))
        self.first = np.append(first, len(terms))

    def nearest(self, query: dict[int, float] | Vector, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, example), ties to the smaller example; only examples that share a term."""
        terms, weights = as_arrays(query)
        if not len(terms) or not self.blocks:
            return []
        lo, hi = self.cells[terms], self.cells[terms + 1]
        cells, weights = ranges(lo, hi), np.repeat(weights, hi - lo)
        block = self.block[cells]
        bound = np.bincount(block, weights * self.maxima[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, found = np.zeros(0), np.zeros(0, np.int64)
        a, turn = 0, 2
        while a < len(order) and bound[order[a]] > 0 and not (len(best) == k and bound[order[a]] < best[-1] - 1e-12):
            now = np.zeros(self.blocks, bool)
            now[order[a : a + turn]] = True
            a, turn = a + turn, turn * 2
            here = now[block]
            lo, hi = self.first[cells[here]], self.first[cells[here] + 1]
            at = ranges(lo, hi)
            scores = np.bincount(self.at[at], np.repeat(weights[here], hi - lo) * self.weights[at], len(self.rows))
            hit = np.flatnonzero(scores > 0)
            hit = hit[self.rows[hit] != without]
            best, found = np.r_[best, np.round(scores[hit], 12)], np.r_[found, self.rows[hit]]
            top = np.lexsort((found, -best))[:k]
            best, found = best[top], found[top]
        return list(zip(best.tolist(), found.tolist()))


class WordIndex:
    """Unit vectors over all words: those in many examples as a matrix, the others as postings; batches of queries meet every example."""

    def __init__(self, vectors: list[Vector], n_terms: int, often: float = 0.05):
        self.n = len(vectors)
        terms, weights = (np.concatenate([v[c] for v in vectors]) if vectors else np.zeros(0, t) for c, t in ((0, np.int64), (1, np.float64)))
        at = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        frequent = np.flatnonzero(np.bincount(terms, minlength=n_terms) > often * self.n)
        self.column = np.full(n_terms, -1)
        self.column[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.n))
        there = self.column[terms] >= 0
        self.dense[self.column[terms[there]], at[there]] = weights[there]
        terms, weights, at = terms[~there], weights[~there], at[~there]
        by = np.argsort(terms, kind="stable")
        self.at, self.weights, self.first = at[by], weights[by], np.searchsorted(terms[by], np.arange(n_terms + 1))

    def nearest(self, queries: list[Vector], k: int, without: list[int] | None = None) -> Iterator[list[tuple[float, int]]]:
        """The k best (cosine, example) of each query, ties to the smaller example; only examples that share a word."""
        for a in range(0, len(queries), 64):
            part = queries[a : a + 64]
            asked = np.zeros((len(part), len(self.dense)))
            for row, (terms, weights) in zip(asked, part):
                place = self.column[terms]
                row[place[place >= 0]] = weights[place >= 0]
            scores = asked @ self.dense
            for j, (s, (terms, weights)) in enumerate(zip(scores, part)):
                lo, hi = self.first[terms], self.first[terms + 1]
                at = ranges(lo, hi)
                s = np.round(s + np.bincount(self.at[at], np.repeat(weights, hi - lo) * self.weights[at], self.n), 12)
                if without is not None:
                    s[without[a + j]] = 0
                least = np.partition(s, -k)[-k] if self.n > k else 0
                hit = np.flatnonzero((s >= least) & (s > 0))
                top = hit[np.lexsort((hit, -s[hit]))[:k]]
                yield list(zip(s[top].tolist(), top.tolist()))


class ToxicityModel:
    """Two tiers, each a finder, the weights of its terms and an index of all examples: telling terms, then all words."""

    def __init__(self, telling: tuple[TermFinder, np.ndarray], words: tuple[TermFinder, np.ndarray], examples: list[tuple[int, int, str]], prior: float, k: int):
        """The tiers' finders and inverse document frequencies; an example is its id, label and text."""
        self.telling, self.words, self.k, self.prior = telling, words, k, prior
        self.ids, self.labels = [e[0] for e in examples], [e[1] for e in examples]
        # examples are drawn by class, so each carries its class's share of the corpus
        n1 = max(1, sum(self.labels))
        n0 = max(1, len(self.labels) - n1)
        self.weight = [prior / n1 if y else (1 - prior) / n0 for y in self.labels]
        counted = [words_in(t) for _, _, t in examples]
        few, every = ([self.vector(tier, w) for w in counted] for tier in (telling, words))
        self.few, self.every = BlockMaxIndex(few, len(telling[1])), WordIndex(every, len(words[1]))
        with_one = [i for i, v in enumerate(few) if len(v[0])]
        known = [i for i, v in enumerate(every) if len(v[0])]
        # a text comes to the second tier only without a telling term, so such examples calibrate it, all where there are none
        others = sorted(set(known) - set(with_one)) or known
        self.curves = [
            self._calibrated(with_one, (self.few.nearest(few[i], k, i) for i in with_one)),
            self._calibrated(others, self.every.nearest([every[i] for i in others], k, others)),
        ]
        none = [i for i, v in enumerate(every) if not len(v[0])]
        self.blank = self._smoothed(sum(self.weight[i] for i in none if self.labels[i]), sum(self.weight[i] for i in none))

    def vector(self, tier: tuple[TermFinder, np.ndarray], words: Counter) -> Vector:
        ids, n = tier[0].count(words)
        v = (1 + np.log(n)) * tier[1][ids]
        return ids, v / math.sqrt(float(v @ v)) if len(v) else v

    def _smoothed(self, positive: float, total: float) -> float:
        n = len(self.labels) or 1
        return (positive + self.prior / n) / (total + 1 / n) if self.labels else self.prior

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, each weighing by its class share and 1 / (distance + 0.1)."""
        pull = [(self.weight[i] / (1.1 - min(1.0, c)), self.labels[i]) for c, i in near]
        total = sum(w for w, _ in pull)
        return sum(w for w, y in pull if y) / total if total else self.prior

    def _calibrated(self, rows: list[int], found: Iterable[list[tuple[float, int]]]) -> Vector:
        """Isotonic regression of labels on leave-one-out votes (pool adjacent violators)."""
        blocks: list[list[float]] = []
        for x, y, w in sorted((self.vote(near), self.labels[i], self.weight[i]) for i, near in zip(rows, found)):
            blocks.append([x, w * y, w])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                _, p, t = blocks.pop()
                blocks[-1][1] += p
                blocks[-1][2] += t
        return np.array([b[0] for b in blocks]), np.array([self._smoothed(b[1], b[2]) for b in blocks])

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """Of each text the score, the nearest examples' ids and the terms searched: the telling ones, or all words where there is none."""
        out: list = [None] * len(texts)

        def settle(at: int, tier: int, v: Vector, near: list[tuple[float, int]]) -> None:
            steps, levels = self.curves[tier]
            if near and len(steps):
                vocabulary = (self.telling, self.words)[tier][0].vocabulary
                out[at] = float(np.interp(self.vote(near), steps, levels)), [self.ids[i] for _, i in near[:5]], [vocabulary[t] for t in v[0]]

        rest = []
        for at, text in enumerate(texts):
            words = words_in(text)
            v = self.vector(self.telling, words)
            if len(v[0]):
                settle(at, 0, v, self.few.nearest(v, self.k))
            if out[at] is None:
                rest.append((at, self.vector(self.words, words)))
        rest = [(at, v) for at, v in rest if len(v[0])]
        for (at, v), near in zip(rest, self.every.nearest([v for _, v in rest], self.k)):
            settle(at, 1, v, near)
        return [x or (self.blank, [], []) for x in out]


def correlation(present: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The squared phi coefficient of each term's presence and the label, from its counts in the classes 0 and 1."""
    b, a = present.astype(float)
    c, d = sizes[1] - a, sizes[0] - b
    whole = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(whole > 0, (a * d - b * c) ** 2 / np.maximum(whole, 1), 0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, k: int = 15, telling_share: float = 0.001) -> ToxicityModel:
    """Fits on at most about ``per_class`` labelled rows of each class outside the held-out fold, with every word of these.

    The ``telling_share`` of their terms that correlates best with the label is searched first; near copies
    among the examples count once in choosing it. Document frequencies come from every document. Without
    labelled rows every score is 0.5.
    """
    prior = class_share(labels, "toxic")
    rows = labelled_texts(docs, labelled_ids(labels, "toxic", per_class)).orderBy("doc_id").toLocalIterator()
    hasher, sizes, kept, marks, present = Hasher(), [0, 0], [], [set() for _ in range(8)], (Counter(), Counter())
    for doc_id, label, text in rows:
        kept.append((doc_id, label, text))
        own = near_copy_marks(hasher, text)
        fresh = sum(m in seen for m, seen in zip(own, marks)) < 4
        terms = all_terms(text)
        # a copy's terms are in the vocabulary, but count no further
        present[label].update(terms if fresh else dict.fromkeys(terms, 0))
        if fresh:
            for m, seen in zip(own, marks):
                seen.add(m)
            sizes[label] += 1
    vocabulary = sorted(present[0].keys() | present[1].keys())
    counts = np.array([[of[t] for t in vocabulary] for of in present], np.int64).reshape(2, -1)
    telling = [vocabulary[t] for t in telling_terms(counts, sizes, telling_share)]
    words = sorted({w for _, _, text in kept for w in words_in(text)})
    finders = [TermFinder(telling), TermFinder(words)]
    frequencies, n = document_frequencies(docs, finders)
    return ToxicityModel(*((f, np.log((n + 1) / (x + 1)) + 1) for f, x in zip(finders, frequencies)), kept, prior, k)


def telling_terms(present: np.ndarray, sizes: list[int], share: float) -> np.ndarray:
    """Numbers, rising, of the share of terms that correlate best with the label, all that tie with the last one included."""
    phi2 = correlation(present, sizes)
    if not phi2.any():
        return np.zeros(0, np.int64)
    least = np.sort(phi2)[::-1][math.ceil(share * len(phi2)) - 1]
    return np.flatnonzero((phi2 >= least) & (phi2 > 0))


def document_frequencies(docs: DataFrame, finders: list[TermFinder]) -> tuple[list[np.ndarray], int]:
    """In how many documents each term of each vocabulary stands, and the number of documents: counted per task, summed by a few tasks, then on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(finders)
    starts = np.cumsum([0, *(len(f.vocabulary) for f in finders)]).tolist()
    size = starts[-1] + 1

    def row(seen: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["seen"])

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.zeros(size, np.int64), shared.value
        for batch in stream:
            for text in batch.column("text").to_pylist():
                words = words_in(text)
                for finder, start in zip(own, starts):
                    seen[start + finder.count(words)[0]] += 1
            seen[-1] += batch.num_rows
        if seen[-1]:
            yield row(seen)

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in stream:
            for x in batch.column("seen"):
                seen += np.frombuffer(x.as_py(), np.int64)
        if seen[-1]:
            yield row(seen)

    sums = id_text(docs).select("text").mapInArrow(count, "seen binary").repartition(8).mapInArrow(add, "seen binary")
    total = np.zeros(size, np.int64)
    for r in sums.toLocalIterator():
        total += np.frombuffer(r[0], np.int64)
    return [total[a:b] for a, b in zip(starts, starts[1:])], int(total[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence: nearest examples' ids and the terms searched.

    Null and empty texts, and texts that share no word with any example, have the calibrated rate of such examples.
    Ties among neighbours go to the smaller doc_id; repeated rows repeat; whole texts of any length are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("neighbours", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])
        own = shared.value

        def rows():
            for batch in stream:
                ids, held, texts = (batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
                for doc_id, h, (s, near, terms) in zip(ids, held, own.scores(texts)):
                    yield doc_id, h, s, int(s >= threshold), near, terms

        yield from batches(rows(), schema)

    return id_text(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(score, SCHEMA)


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = in_small_batches(docs).columns.index("text")

    def sieve(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in stream:
            clean = [s < threshold for s, _, _ in own.scores(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(sieve, docs.schema)
