"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models over lower-cased words, one of toxic and one of ordinary texts. A class's bigrams are
discounted occurrence counts, its words discounted continuation counts (distinct words before it), and below both lie
continuation counts that the classes share: P(w|v) = bigram(v, w) + weight(v) x (word(w) + weight x shared(w)). So an
expression that either class has hardly seen gets nearly the same probability from both. Every token of a text is scored
under both models, with all their masses.

A text is compared by its length-normalised log-likelihoods: the difference over a power of the length, kept apart by
how often the words occur in the shared counts (octaves), once as it is and once weighted by its square, since the
many small differences of frequent words are those of topics and languages. A logistic curve over these, fitted on
training texts left out of the counts, gives the score.

Learning takes a bounded sample of labelled rows: of each class the ``SAMPLE`` with the least hash of doc_id, as far as
``SAMPLE_BYTES`` reach (the row that crosses them is the last one), one row of each doc_id. Scoring covers every whole text.

Edge cases: null and empty texts are scored by the curve's bias alone; null labels are not learned from; a label of a
repeated doc_id is the largest, and its text the least; a null doc_id is scored and counts as held out; where a class has no
labelled row every score is 0.0; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SLICE_BYTES, Hasher, lower, rows, slices
from .tables import sample, table

#: Labelled rows of each class that are learned from, whole, and about how many bytes of them.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 20
DISCOUNT = 0.75
#: Octaves of shared counts that are kept apart; the last one holds all beyond.
BANDS = 14
RIDGE = 0.1
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_WORD = Hasher(31)
_EDGE = np.zeros(256, bool)
for _c in range(256):
    _EDGE[_c] = not (48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of ASCII letters, digits, and bytes beyond ASCII), lower-cased, and each text's first."""
    data = lower(data)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = ~_EDGE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    s = np.flatnonzero(start)
    return _WORD.of(_WORD.prefix(data), s, np.flatnonzero(end) + 1), np.searchsorted(s, offs)


def _chunks(texts: list[bytes], limit: int = SLICE_BYTES // 8):
    """Runs of texts of about ``limit`` bytes, as one buffer and offsets each: hashing needs many times a text's bytes."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield _join(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield _join(part)


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


class Model:
    """Both class models over one vocabulary, and the curve.

    ``words`` are sorted hashes; ``p`` and ``weight`` hold, for each class, a word's probability and the mass that its
    successors leave to their words, with two more places: words never seen, and the mark before a text. ``pairs`` are
    sorted (word before, word) numbers and ``q`` their discounted shares.
    """

    def __init__(self, words, band, p, weight, pairs, q, curve=None, bias: float = 0.0, power: float = 1.0):
        self.words, self.band, self.p, self.weight, self.pairs, self.q, self.curve, self.bias, self.power = words, band, p, weight, pairs, q, curve, bias, power

    def packed(self) -> bytes:
        """To be sent: sorted numbers as differences, all compressed."""
        state = np.diff(self.words, prepend=np.uint64(0)), self.band.astype(np.int8), self.p, self.weight, np.diff(self.pairs, prepend=0), self.q, self.curve, self.bias, self.power
        return zlib.compress(pickle.dumps(state), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        words, band, p, weight, pairs, *rest = pickle.loads(zlib.decompress(data))
        return cls(np.cumsum(words), band, p, weight, np.cumsum(pairs), *rest)

    def places(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each token and of the one before it, and each text's first token."""
        w, first = tokens(data, offs)
        n = len(self.words)
        at = np.minimum(np.searchsorted(self.words, w), n - 1)
        at = np.where(self.words[at] == w, at, n)
        before = np.concatenate([[n + 1], at[:-1]]) if len(at) else at
        before[first[:-1][first[:-1] < len(at)]] = n + 1
        return at, before, first

    def logs(self, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each token under each class: of the whole model, and of its word level alone."""
        key = before * np.int64(len(self.words) + 2) + at
        k = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        seen = self.pairs[k] == key if len(self.pairs) else np.zeros(len(key), bool)
        word = self.p[:, at]
        return np.log(np.where(seen, self.q[:, k] if len(self.pairs) else 0, 0) + self.weight[:, before] * word), np.log(word)

    def features(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the differences of its tokens' logs, summed by octave and power, and its length."""
        at, before, first = self.places(data, offs)
        whole, word = (x[1] - x[0] for x in self.logs(at, before))
        n = len(offs) - 1
        cell = np.repeat(np.arange(n), np.diff(first)) * (BANDS + 1)
        found = []
        for power in (1, 3):
            by_band = np.bincount(cell + self.band[at], word**power, minlength=n * (BANDS + 1))
            top = np.bincount(cell + BANDS, (whole - word) ** power, minlength=n * (BANDS + 1))
            found.append((by_band + top).reshape(n, -1))
        return np.concatenate(found, axis=1), np.maximum(np.diff(first), 1)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, length = self.features(data, offs)
        return 1 / (1 + np.exp(-np.clip(x / length[:, None] ** self.power @ self.curve + self.bias, -700, 700)))


def count(ordinary: list[bytes], toxic: list[bytes]) -> Model:
    """The class models of two lists of texts, without a curve."""
    held = [[tokens(*chunk) for chunk in _chunks(texts)] for texts in (ordinary, toxic)]
    words = np.unique(np.concatenate([w for parts in held for w, _ in parts]))
    n = len(words)
    model = Model(words, None, None, None, np.empty(0, np.int64), None)
    seen = []
    for texts in (ordinary, toxic):
        parts = [model.places(*chunk) for chunk in _chunks(texts)]
        key = np.concatenate([before * np.int64(n + 2) + at for at, before, _ in parts])
        seen.append(np.unique(key, return_counts=True))
    contexts = [np.bincount(key % (n + 2), minlength=n + 1)[: n + 1].astype(float) for key, _ in seen]
    total = contexts[0] + contexts[1]
    shared = (total + 0.5) / (total + 0.5).sum()
    pairs = np.unique(np.concatenate([key for key, _ in seen]))
    p, weight, q = np.empty((2, n + 2)), np.ones((2, n + 2)), np.zeros((2, len(pairs)), np.float32)
    for c, ((key, times), own) in enumerate(zip(seen, contexts, strict=True)):
        kept = np.maximum(own - DISCOUNT, 0) / max(1.0, own.sum())
        p[c, : n + 1] = kept + (1 - kept.sum()) * shared
        before = key // (n + 2)
        share = np.maximum(times - DISCOUNT, 0) / np.maximum(np.bincount(before, times, minlength=n + 2), 1)[before]
        weight[c] -= np.bincount(before, share, minlength=n + 2)
        q[c, np.searchsorted(pairs, key)] = share
    p[:, n + 1] = 1.0  # the mark is never predicted
    band = np.minimum(np.log2(np.maximum(np.append(total, 0), 1)).astype(np.int64), BANDS - 1)
    return Model(words, band, p, weight, pairs, q)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Curve, bias and loss of a logistic regression: Newton steps with a weak ridge, over features of equal spread."""
    spread = np.maximum(x.std(0), 1e-9)
    u, theta = np.concatenate([x / spread, np.ones((len(x), 1))], axis=1), np.zeros(x.shape[1] + 1)
    chance = lambda: 1 / (1 + np.exp(-np.clip(u @ theta, -30, 30)))
    for _ in range(50):
        p = chance()
        slope = u.T @ (weight * (p - y)) + RIDGE * theta
        bend = (u * (weight * p * (1 - p))[:, None]).T @ u + RIDGE * np.eye(len(theta))
        theta -= np.linalg.solve(bend, slope)
    p = np.clip(chance(), 1e-9, 1 - 1e-9)
    return theta[:-1] / spread, float(theta[-1]), float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def train(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model | None:
    """Counts of three quarters of the texts, the curve from the rest; ``share`` is the toxic rows' share among labelled ones."""
    if not toxic or not ordinary:
        return None
    split = lambda xs: ([x for i, x in enumerate(xs) if i % 4], [x for i, x in enumerate(xs) if not i % 4])
    (tf, tr), (of, orr) = split(toxic), split(ordinary)
    model = count(of or orr, tf or tr)
    y = np.concatenate([np.ones(len(tr)), np.zeros(len(orr))])
    weight = np.where(y == 1, share / len(tr), (1 - share) / len(orr)) * len(y)
    parts = [model.features(*chunk) for chunk in _chunks([*tr, *orr])]
    x, length = (np.concatenate(v) for v in zip(*parts, strict=True))
    fits = [(*fit(x / length[:, None] ** power, y, weight), power) for power in (1.0, 0.5)]
    model.curve, model.bias, _, model.power = min(fits, key=lambda f: f[2])
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """From labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    found = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {}
    for label in (1, 0):
        got[label] = [r["text"].encode() for r in sample(docs, known.where(F.col("toxic") == label), SAMPLE, SAMPLE_BYTES)]
    return train(got[1], got[0], found.get(1, 0) / max(1, sum(found.values())))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model and model.packed())

    def run(batches):
        x = shared.value
        m = x and Model.unpacked(x)
        for s in slices(batches):
            p = m.score(s.data, s.offs) if m else np.zeros(len(s))
            yield rows(_ARROW, s.ids, s.batch.column(2), p, (p >= 0.5).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(run, SCHEMA)


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that the model does not reject. A map over the texts: no shuffle."""
    model = learn(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches):
        m = Model.unpacked(shared.value)
        for s in slices(batches):
            yield s.batch.filter(pa.array(m.score(s.data, s.offs) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
