"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 code points of the text (letters of the basic plane in lower case, with their
combining marks; each run of other characters one space), in ``FEATURES`` slots. A text's term frequencies are divided by its number of n-grams and weighted by inverse document
frequency, so a logit is a mean over its n-grams and whole texts of any length are scored in one pass.

Training is follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) over a bounded sample of labelled
rows (of ``SAMPLE`` documents with the least hash of doc_id, as far as ``SAMPLE_BYTES`` reach), then one temperature is fitted on a part of the
sample that training has not seen. The model (weights of FEATURES x languages) has a fixed bound on its size.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows with null lang are never learned from;
a null doc_id is scored and counts as held out; ties between languages go to the first by name; with no labelled row
everything is ``und``; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, rows, slices
from .tables import sample, table

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that the classifier learns from, whole, and about how many bytes of them.
SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
#: Code points whose n-grams are weighed at once.
PART = 1 << 18
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
EPOCHS, BATCH = 3, 32
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case form, or a space if it isn't a letter or combining mark."""
    out = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if unicodedata.category(chr(c))[0] in "LM":
            x = chr(c).lower()
            out[c] = ord(x) if len(x) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def lettered(text: bytes) -> bool:
    """A letter is anywhere in the text; marks and digits alone are none."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def symbols(text: bytes) -> np.ndarray:
    """Folded code points, with one space at either end and for each run of other characters."""
    if not _FOLD:
        _FOLD.append(_letters())
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    s = np.full(len(c) + 2, 32, np.uint32)
    low = c < 0x10000
    s[1:-1] = np.where(low, _FOLD[0][np.where(low, c, 0)], [ord(x) if x.isalpha() else 32 for x in map(chr, c.tolist())] if not low.all() else 32)
    return s[np.concatenate([[True], (s[1:] != 32) | (s[:-1] != 32)])]


def grams(s: np.ndarray, start: int = 0, most: int | None = None) -> np.ndarray:
    """Hashed features of the n-grams of the folded text that begin at ``start`` or one of ``most`` places from it, repeats included."""
    most = len(s) - start if most is None else most
    s = s[start : start + most + max(ORDERS) - 1]
    out, key = [], np.zeros(len(s), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        key = (key[: len(s) - n + 1] << np.uint64(21)) | s[n - 1 :].astype(np.uint64)
        if n in ORDERS:
            out.append((mix(key[:most] + np.uint64(n)) >> np.uint64(48)) % np.uint64(FEATURES))
    return np.concatenate(out).astype(np.int64)


class Model:
    """Weights times IDF by feature and language, bias, and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def logits(self, s: np.ndarray) -> np.ndarray:
        """Of a folded text, part by part: a text's n-grams are many times its bytes."""
        total, n = np.zeros(len(self.languages)), 0
        for a in range(0, len(s), PART):
            features = grams(s, a, PART)
            total += self.weights[features].sum(0, dtype=np.float64)
            n += len(features)
        return total / n + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.languages or not lettered(text):
            return "und", 0.0
        z = self.logits(symbols(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.languages[k], float(p[k] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(examples: list[tuple[bytes, str]]) -> Model:
    """Fit on (text, language) pairs; deterministic in the order given."""
    languages = sorted({lang for _, lang in examples})
    # counts at once, text by text: a text's n-grams are many times its bytes
    xs = [(np.unique(grams(s), return_counts=True), languages.index(lang)) for t, lang in examples if len(s := symbols(t)) > 1]
    if not xs:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    df = np.zeros(FEATURES, np.int64)
    for (f, _), _ in xs:
        df[f] += 1
    idf = np.log((1 + len(xs)) / (1 + df)) + 1
    data = [(f, 20 * c / c.sum() * idf[f], y) for (f, c), y in xs]
    fit, rest = [d for i, d in enumerate(data) if i % 5], [d for i, d in enumerate(data) if not i % 5]
    k = len(languages)
    z, n, zb, nb = np.zeros((FEATURES, k)), np.zeros((FEATURES, k)), np.zeros(k), np.zeros(k)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for a in range(0, len(fit), BATCH):
            part = fit[a : a + BATCH]
            f = np.concatenate([d[0] for d in part])
            x = np.concatenate([d[1] for d in part])
            row = np.repeat(np.arange(len(part)), [len(d[0]) for d in part])
            used, local = np.unique(f, return_inverse=True)
            w, wb = weight(z[used], n[used]), weight(zb, nb)
            logit = np.add.reduceat(w[local] * x[:, None], np.searchsorted(row, np.arange(len(part)))) + wb
            g = _softmax(logit)
            g[np.arange(len(part)), [d[2] for d in part]] -= 1
            grad = np.zeros_like(w)
            np.add.at(grad, local, g[row] * x[:, None])
            for zz, nn, gg, ww, at in ((z, n, grad, w, used), (zb, nb, g.sum(0), wb, slice(None))):
                sigma = (np.sqrt(nn[at] + gg * gg) - np.sqrt(nn[at])) / ALPHA
                zz[at] += gg - sigma * ww
                nn[at] += gg * gg
    w, wb = weight(z, n), weight(zb, nb)
    if rest:
        logit = np.stack([(w[f] * x[:, None]).sum(0) + wb for f, x, _ in rest])
        y = np.array([d[2] for d in rest])
        loss = [(-np.log(np.maximum(_softmax(logit / t)[np.arange(len(y)), y], 1e-12)).mean(), t) for t in np.geomspace(0.1, 10, 61)]
        temperature = float(min(loss)[1])
    else:
        temperature = 1.0
    return Model(languages, (w * idf[:, None] * 20).astype(np.float32), wb, temperature)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, with ``held_out`` passed through."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias, model.temperature))

    def run(batches):
        m = Model(*shared.value)
        for s in slices(batches):
            found = [m.predict(s.text(i)) for i in range(len(s))]
            yield rows(_ARROW, s.ids, s.batch.column(2), [x[0] for x in found], [x[1] for x in found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, SCHEMA)


def op4_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    usable = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learned = sample(usable, usable, SAMPLE, SAMPLE_BYTES, "lang")
    model = train([(r["text"].encode(), r["lang"]) for r in learned])
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model)
