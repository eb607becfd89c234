"""Language identification of code-switched text by a linear-chain CRF over words.

A word's features are its affixes and inner character n-grams (byte n-grams of the word between
boundary marks) and its entry in a learned lexicon (the hashed whole word). Transitions between the
languages of neighbouring words are learned too. Forward-backward gives each word a distribution;
a document's language is the one with the largest mean posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import U64, batches, held_out, id_text, in_small_batches, mix

WORD = re.compile(r"[^\W\d_]+")
TABLE = 1 << 17
GRAMS = (2, 3, 4)
PIECE = 64  # bytes of a word; longer runs of letters are consecutive words of at most as many
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of the words, and the word each belongs to."""
    marked = b"".join(b"\x02%b\x03" % w for w in words)
    x = np.frombuffer(marked, np.uint8).astype(U64)
    starts = np.nonzero(x == 2)[0]
    owner = np.cumsum(x == 2) - 1
    ends = np.append(starts[1:], len(x))
    ids, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, U64(n))
            for k in range(n):
                h = h * U64(1099511628211) + x[k : len(x) - n + 1 + k]
            fits = np.arange(len(h)) + n <= ends[owner[: len(h)]]
            ids.append((mix(h[fits]) % U64(TABLE)).astype(np.int64))
            owners.append(owner[: len(h)][fits])
        whole = np.add.reduceat(mix(x + (np.arange(len(x), dtype=U64) - starts[owner].astype(U64)) * U64(257)), starts) if len(x) else np.zeros(0, U64)
    ids.append((mix(whole + U64(9)) % U64(TABLE)).astype(np.int64))
    owners.append(np.arange(len(words)))
    return np.concatenate(ids), np.concatenate(owners)


def pieces(word: bytes) -> Iterator[bytes]:
    """The whole word in consecutive pieces of at most PIECE bytes, cut between characters."""
    a = 0
    while a < len(word):
        b = min(len(word), a + PIECE)
        while b < len(word) and word[b] & 0xC0 == 0x80:
            b -= 1
        yield word[a:b]
        a = b


def words_of(text: str) -> list[bytes]:
    words = " ".join(WORD.findall(text.lower())).encode().split(b" ") if text else []
    return [p for w in words for p in pieces(w)] if any(len(w) > PIECE for w in words) else words


class LanguageModel:
    """Languages, feature weights and transitions; emissions of a word are remembered while it is frequent."""

    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray):
        self.languages, self.weights, self.trans = languages, weights.astype(np.float32), trans.astype(np.float32)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            ids, owner = word_features(part)
            for j in range(len(self.languages)):
                out[a : a + len(part), j] = np.bincount(owner, self.weights[ids, j], len(part))
        return out

    def posteriors(self, words: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Word posteriors (words, languages); each text's words are one chain, of whatever length."""
        index: dict[bytes, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        return crf.posteriors(self.emissions(list(index))[at], lengths, self.trans)


def text_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text; zero for texts without."""
    out = np.zeros((len(lengths), values.shape[1]))
    full = np.flatnonzero(lengths)
    if len(full):
        out[full] = np.add.reduceat(values.astype(float), (np.cumsum(lengths) - lengths)[full], axis=0)
    return out


def training_rows(docs: DataFrame, per_language: int, texts: int, words_per_text: int = 800) -> list[tuple[str, str]]:
    """(lang, text) of every language, up to ``per_language`` of each and fewer where these are more than ``texts`` in all, from rows outside the held-out fold; a text is its words, or runs of them from all over it (see ``spread``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, texts // len(counts)))
    # a share of each language's rows, chosen by hash; at most twice the wanted number ever travels
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, max(1.2 * per_language, 20) / n)))])
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    picked = rows.where(F.col("lang").isin(list(counts)) & pick).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).limit(2 * max(per_language, 20) * len(counts))

    def shorten(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [b" ".join(spread(words_of(t), words_per_text)).decode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(texts, pa.string()), batch.column("h")], names=["lang", "text", "h"])

    found = in_small_batches(picked).mapInArrow(shorten, "lang string, text string, h long").collect()
    return [(r[0], r[1]) for r in sorted(found, key=lambda r: (r[0], r[2], r[1]))]


def spread(words: list[bytes], most: int) -> list[bytes]:
    """All words, or about ``most`` of them: runs of 40 at even distances from the first to the last word."""
    if len(words) <= most:
        return words
    starts = np.linspace(0, len(words) - 40, max(2, most // 40)).astype(int)
    return [w for a in starts for w in words[a : a + 40]]


def fit_language(docs: DataFrame, *, per_language: int = 300, texts: int = 25_600, words_per_text: int = 400, seed: int = 5) -> LanguageModel | None:
    """A model from a bounded sample: at most about ``per_language`` texts of each language, fewer (but about 20) where these are more than ``texts``; every value that is not null is learned.

    Training chains splice runs of 8 to 64 words of differing documents, so that switches are seen.
    None if no row outside the held-out fold has a language and a word.
    """
    rng = np.random.default_rng(seed)
    samples = [(lang, w) for lang, text in training_rows(docs, per_language, texts, words_per_text) if (w := words_of(text)) and w != [b""]]
    if not samples:
        return None
    langs = sorted({lang for lang, _ in samples})
    runs = []
    for lang, w in samples:
        at = 0
        while at < len(w):
            n = int(rng.integers(8, 65))
            runs.append((langs.index(lang), w[at : at + n]))
            at += n
    order = rng.permutation(len(runs))
    words, labels, lengths, index = [], [], [], {}
    for a in range(0, len(order), 2):
        pair = [runs[i] for i in order[a : a + 2]]
        for label, run in pair:
            words += [index.setdefault(x, len(index)) for x in run]
            labels += [label] * len(run)
        lengths.append(sum(len(run) for _, run in pair))
    ids, owner = word_features(list(index))
    w, trans = crf.fit(ids, owner, len(index), TABLE, np.array(words), np.array(labels), np.array(lengths), len(langs), rounds=25)
    return LanguageModel(langs, w, trans)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the mean posterior of the predicted language over all words.

    ``und`` with score 0 where the text is null or has no letter, or no model could be learned. Ties go to
    the language first in order. Repeated rows repeat; only text is an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
        own = shared.value

        def rows():
            for part in lots(stream, ("doc_id", "held_out", "text")):
                texts = [chain_of(t) for _, _, t in part]
                lengths = np.array([len(w) for w in texts], np.int64)
                if own is None or not lengths.any():
                    yield from ((i, h, "und", 0.0) for i, h, _ in part)
                    continue
                total = text_sums(own.posteriors([w for ws in texts for w in ws], lengths), lengths)
                best = total.argmax(axis=1)
                score = np.clip(total[np.arange(len(best)), best] / np.maximum(lengths, 1), 0, 1)
                for (i, h, _), b, x, n in zip(part, best.tolist(), score.tolist(), lengths.tolist()):
                    yield (i, h, own.languages[b], x) if n else (i, h, "und", 0.0)

        yield from batches(rows(), schema)

    return id_text(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(predict, SCHEMA)


def chain_of(text: str | None) -> list[bytes]:
    words = words_of(text) if text else []
    return [] if words == [b""] else words


def lots(stream: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int = 8_000_000) -> Iterator[list[tuple]]:
    """Rows, the text last, in lots of about ``most`` characters: long chains run beside others."""
    held, size = [], 0
    for batch in stream:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            held.append(row)
            size += len(row[-1] or "")
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def label_words(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, words, langs: the language of every word of code-switched text, by its own posterior (ties go to the language first in order).

    Words are lower-cased runs of letters, longer ones in consecutive pieces; null texts have none; repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string()))])
        own = shared.value

        def rows():
            for part in lots(stream, ("doc_id", "text")):
                texts = [chain_of(t) for _, t in part]
                lengths = np.array([len(w) for w in texts], np.int64)
                best = own.posteriors([w for ws in texts for w in ws], lengths).argmax(axis=1) if lengths.any() else []
                at = 0
                for (i, _), words in zip(part, texts):
                    yield i, [w.decode() for w in words], [own.languages[b] for b in best[at : at + len(words)]]
                    at += len(words)

        yield from batches(rows(), schema)

    return id_text(docs).mapInArrow(label, "doc_id long, words array<string>, langs array<string>")


def identify(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Fits on ``docs`` (text and lang) and predicts every row."""
    return predict_language(docs, fit_language(docs, **options))
