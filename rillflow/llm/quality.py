"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are sampled rows labelled 1; unlabelled texts are those of the corpus, labels
unseen (a sample of them in the gradient steps). With class prior p, the risk of a logistic scorer is p * R(positives as 1) +
max(0, R(unlabelled as 0) - p * R(positives as 0)); where the second part turns negative its gradient
is reversed. The prior is the smallest ratio of the unlabelled to the positive share above a score,
which is never below it but for chance; the unlabelled share is counted over all texts, each scored by
a scorer that has not seen it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text
from .crf import Adam
from .sampling import labelled_ids, labelled_texts

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
EXTRA = 14


def describe(text: str | None) -> np.ndarray:
    """The features of a whole text: square roots of its byte shares, and shape figures of words and lines."""
    data = (text or "").encode()
    out = np.zeros(256 + EXTRA, np.float32)
    if not data:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:256] = np.sqrt(counts / len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(words))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[256:-1] = [
        np.log1p(len(data)) / 10,
        np.log1p(n) / 10,
        len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5,
        len(data) / n / 20,
        counts[65:91].sum() / max(1, letters),
        letters / len(data),
        counts[48:58].sum() / len(data),
        sum(w.isupper() for w in words) / n,
        sum(len(w) == 1 for w in words) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / len(data),
    ]
    return out


class QualityModel:
    def __init__(self, mean: np.ndarray, dev: np.ndarray, w: np.ndarray, bias: float, prior: float):
        self.mean, self.dev, self.w, self.bias, self.prior = mean, dev, w, bias, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -8, 8) @ self.w + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150) -> np.ndarray:
    w = np.zeros(x.shape[1])
    opt = Adam(w.shape, 0.05)
    for _ in range(rounds):
        opt.step(w, (x * (weight * (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))))[:, None]).sum(0) - 1e-4 * w)
    return w


FOLDS = 4


def fold_scorers(p: np.ndarray, u: np.ndarray, fold_p: np.ndarray, fold_u: np.ndarray) -> np.ndarray:
    """For each fold the weights of a scorer of positives against unlabelled that has seen none of the fold's rows."""
    out = np.zeros((FOLDS, p.shape[1]))
    for k in range(FOLDS):
        a, b = p[fold_p != k], u[fold_u != k]
        if len(a) and len(b):
            out[k] = logistic(np.vstack([a, b]), np.r_[np.ones(len(a)), np.zeros(len(b))], np.r_[np.full(len(a), 0.5 / len(a)), np.full(len(b), 0.5 / len(b))])
    return out


def thresholds(positive: np.ndarray) -> np.ndarray:
    """Quantiles of the positives' scores up to the median: where at least half of them lie above."""
    p = np.sort(positive)
    return p[np.minimum(len(p) - 1, (np.linspace(0.0, 0.5, 51) * len(p)).astype(int))]


def class_prior(above_p: np.ndarray, above_u: np.ndarray) -> float:
    """Smallest ratio of the unlabelled to the positive share above a threshold."""
    return float(np.clip((above_u / np.maximum(above_p, 1e-9)).min(initial=1.0), 0.05, 0.98))


def non_negative_fit(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, decay: float = 0.012) -> np.ndarray:
    """Weights that minimise the non-negative risk with the logistic loss and a quadratic penalty; the last column is the bias."""
    w = np.zeros(p.shape[1])
    opt = Adam(w.shape, 0.02)
    for _ in range(rounds):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        as_one = (p * (sp - 1)[:, None]).mean(0)
        rest = -np.log(np.maximum(1 - su, 1e-9)).mean() - prior * -np.log(np.maximum(1 - sp, 1e-9)).mean()
        rest_grad = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        opt.step(w, -(prior * as_one + rest_grad if rest >= 0 else -rest_grad) - decay * w)
    return w


def described(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and features (float32 as binary)."""
    schema = docs.select(*columns).schema.add("features", "binary")
    names = [*columns, "features"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            features = [describe(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(features, pa.binary())], names=names)

    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(run, schema)


def matrix(rows: list, at: int = 0) -> np.ndarray:
    return np.stack([np.frombuffer(r[at], np.float32) for r in rows]) if rows else np.zeros((0, 256 + EXTRA), np.float32)


def summed(docs: DataFrame, figures: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``figures`` (features and folds of a batch to ``size`` numbers): one row a task, summed by a few tasks."""

    def row(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in stream:
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 256):
                total += figures(np.stack([describe(t) for t in texts[a : a + 256]]), np.asarray(batch.column("fold"))[a : a + 256])
        yield row(total)

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in stream:
            for x in batch.column("total"):
                total += np.frombuffer(x.as_py())
        yield row(total)

    sums = docs.select("text", fold_of("doc_id").alias("fold")).mapInArrow(count, "total binary").repartition(8).mapInArrow(add, "total binary")
    return sum((np.frombuffer(r[0]) for r in sums.toLocalIterator()), np.zeros(size))


def fold_of(column: str):
    return F.pmod(F.xxhash64(F.col(column), F.lit(2)), F.lit(FOLDS)).cast("int")


def fit_quality(docs: DataFrame, labels: DataFrame, *, positives: int = 4000, unlabelled: int = 8000) -> QualityModel | None:
    """Fits on at most about ``positives`` rows labelled 1 and ``unlabelled`` texts, none of the held-out fold; None without either.

    The samples serve the gradient steps alone. Means and deviations of the features, and the shares above the
    thresholds that the class prior needs, come from every text outside the held-out fold. Only figures of
    texts travel to the driver, so long texts cost nothing there.
    """
    trusted = [(i, y) for i, y in labelled_ids(labels, "quality", positives) if y]
    if not trusted:
        return None
    chosen = described(labelled_texts(docs, trusted), ["doc_id"]).withColumn("fold", fold_of("doc_id")).orderBy("doc_id").select("features", "fold").collect()
    pool = id_text(docs).where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    width = 256 + EXTRA
    total = summed(pool, lambda x, _: np.concatenate([[len(x)], x.sum(0, dtype=float), (x.astype(float) ** 2).sum(0)]), 1 + 2 * width)
    if not chosen or not total[0]:
        return None
    mean = total[1 : 1 + width] / total[0]
    dev = np.maximum(np.sqrt(np.maximum(total[1 + width :] / total[0] - mean**2, 0)), 1e-3)
    share = min(1.0, unlabelled / total[0])
    pick = pool.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1_000_000)) < share * 1_000_000)
    some = described(pick, ["doc_id"]).withColumn("fold", fold_of("doc_id")).orderBy("doc_id").select("features", "fold").collect()
    if not some:
        return None
    one = lambda x: np.hstack([np.clip((x - mean) / dev, -8, 8), np.ones((len(x), 1))])
    zp, zu = one(matrix(chosen)), one(matrix(some))
    folds = np.array([r[1] for r in chosen])
    scorers = fold_scorers(zp, zu, folds, np.array([r[1] for r in some]))
    unseen = np.einsum("ij,ij->i", zp, scorers[folds])
    steps = thresholds(unseen)
    above = summed(pool, lambda x, fold: np.r_[(np.einsum("ij,ij->i", one(x), scorers[fold])[:, None] >= steps).sum(0), len(x)], len(steps) + 1)
    prior = class_prior((unseen[:, None] >= steps).mean(0), above[:-1] / max(1.0, above[-1]))
    w = non_negative_fit(zp, zu, prior)
    return QualityModel(mean, dev, w[:-1], float(w[-1]), prior)


def score_quality(docs: DataFrame, model: QualityModel | None, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. Null texts score as empty ones; without a model every score is 0.5; repeated rows repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in stream:
            texts = batch.column("text").to_pylist()
            s = own.scores(np.stack([describe(t) for t in texts])) if own and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s.astype(float)), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return id_text(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(score, SCHEMA)
