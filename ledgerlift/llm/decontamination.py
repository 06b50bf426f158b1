"""Benchmark decontamination by spaced-seed hashing.

Texts are token sequences (lower-cased runs of letters and digits). Each mask of ``MASKS`` is laid over every position
of a text; a seed is the hash of the tokens at its 1s, so tokens at its 0s may differ. Seeds shared by a benchmark item
and a document fix an alignment; around it the best aligned passage is scored (+1 a match, -4 a substitution, so that
at least 80 % match) and counts from ``PASSAGE`` tokens, or the whole item if that is shorter.

Benchmark tokens up to ``TABLE_BYTES`` of text are sent to all tasks as a sorted table of seeds and documents are
only mapped over. A larger benchmark is joined with the documents' seeds in a shuffle, and the hits with both texts;
both ways verify with the same function.

Edge cases: items shorter than ``PASSAGE`` must match in whole, those under five tokens without a substitution; null and empty texts on either side have no passages; an item whose id is null is used and reported as null;
rows with a null doc_id are left out; repeated rows and items give one row for each doc_id and item_id; empty tables
give no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, raw, rows, slices
from .tables import table, written
from .toxicity import tokens

#: The narrow mask misses no passage: before its first substitution a passage has five matches at least, as fewer would
#: not outweigh ``PENALTY`` and the best passage would start after it; without substitutions it has all its tokens.
MASKS = ("1101100101011", "1110010110101", "11111")
#: Tokens of an aligned passage that counts, of which at least 80 % match.
PASSAGE = 13
PENALTY = 4
TABLE_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, start long, length long, matched long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "start", "length", "matched")])


def seeds(w: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the selected tokens at each position."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return mix(h)


def passage(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the document, length, matches) of the best passage where item position 0 lies at ``shift``."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    same = doc[a:b] == item[a - shift : b - shift]
    c = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    low = np.minimum.accumulate(c)
    end = int(np.argmax(c - low))
    start = int(np.flatnonzero(c[: end + 1] == low[end])[-1])
    if end - start < min(PASSAGE, len(item)):
        return None
    return a + start, end - start, int(same[start:end].sum())


class Items:
    """A benchmark's token sequences and the sorted table of their seeds."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        data = np.frombuffer(b"".join(texts), np.uint8)
        w, first = tokens(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        self.tokens = [w[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        h, item, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.spans = []
        for m, mask in enumerate(MASKS):
            for i, t in enumerate(self.tokens):
                s = seeds(t, mask, m)
                h.append(s)
                item.append(np.full(len(s), i))
                at.append(np.arange(len(s)))
        h, item, at = map(np.concatenate, (h, item, at))
        order = np.argsort(h, kind="stable")
        self.seeds, self.item, self.at = h[order], item[order], at[order]
        # a bitmap of the seeds' low bits answers most documents' positions without a search
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.seeds & np.uint64((1 << 22) - 1)] = True
        self.tiny = [i for i, t in enumerate(self.tokens) if 0 < len(t) < 5]

    def hits(self, w: np.ndarray) -> set[tuple[int, int]]:
        """(item, shift) of all shared seeds."""
        found = set()
        for m, mask in enumerate(MASKS):
            s = seeds(w, mask, m)
            p = np.flatnonzero(self.maybe[s & np.uint64((1 << 22) - 1)])
            lo, hi = np.searchsorted(self.seeds, s[p]), np.searchsorted(self.seeds, s[p], "right")
            for q, a, b in zip(p[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update((int(self.item[k]), q - int(self.at[k])) for k in range(a, b))
        for i in self.tiny:
            t = self.tokens[i]
            at = np.flatnonzero(w[: max(0, len(w) - len(t) + 1)] == t[0])
            found.update((i, int(p)) for p in at if (w[p : p + len(t)] == t).all())
        return found

    def overlaps(self, w: np.ndarray) -> dict:
        """item_id -> its longest verified passage in the document."""
        best: dict = {}
        for i, shift in sorted(self.hits(w)):
            got = passage(w, self.tokens[i], shift)
            if got and (self.ids[i] not in best or (got[2], -got[0], got[1]) > (best[self.ids[i]][2], -best[self.ids[i]][0], best[self.ids[i]][1])):
                best[self.ids[i]] = got
        return best


def _scan(items: Items, batches):
    for s in slices(batches):
        w, first = tokens(s.data, s.offs)
        out = [(k, item, *got) for i, k in enumerate(s.ids.to_pylist()) for item, got in items.overlaps(w[first[i] : first[i + 1]]).items()]
        yield rows(_ARROW, *(zip(*out, strict=True) if out else [[]] * 5))


def _lengths(batches):
    """Token counts under five of items."""
    for s in slices(batches, ids="id"):
        first = tokens(s.data, s.offs)[1]
        n = np.unique(np.diff(first))
        yield rows(pa.schema([("n", pa.int64())]), n[(n > 0) & (n < 5)])


def _seed_rows(kind: str, lengths: list[int]):
    """Seeds of each text, for the shuffled way: (seed, id, at); of items those seeds that ``Items`` would hold.

    Items of ``lengths`` tokens, each under five, have one seed of all their tokens, and documents those of all runs as long.
    """
    schema = pa.schema([("seed", pa.int64()), ("id", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for s in slices(batches, ids="id"):
            w, first = tokens(s.data, s.offs)
            out = []
            for i, key in enumerate(s.ids.to_pylist()):
                t = w[first[i] : first[i + 1]]
                for m, mask in enumerate(MASKS):
                    h = seeds(t, mask, m)
                    out.append((h.view(np.int64), np.full(len(h), key), np.arange(len(h))))
                for n in lengths if kind == "doc" else {len(t)} & {*lengths}:
                    h = seeds(t, "1" * n, len(MASKS) + n)
                    out.append((h.view(np.int64), np.full(len(h), key), np.arange(len(h))))
            yield rows(schema, *(np.concatenate(x) for x in zip(*out, strict=True))) if out else rows(schema, [], [], [])

    return run, "seed long, id long, at long"


def _verify(batches):
    for batch in batches:
        texts = [raw(batch.column(i)) for i in (2, 3)]
        seqs = [tokens(*x) for x in ((d[o[0] : o[-1]], o - o[0]) for d, o in texts)]
        out = []
        for r, (doc, item, shift) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True)):
            d, q = (w[f[r] : f[r + 1]] for w, f in seqs)
            if got := passage(d, q, shift):
                out.append((doc, item, *got))
        yield rows(_ARROW, *(zip(*out, strict=True) if out else [[]] * 5))


def overlaps(docs: DataFrame, benchmark: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, item_id, start, length, matched): verified passages, in tokens of the document; one row a pair, the longest."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    if size <= table_bytes:
        got = sorted((r["item_id"] is not None, r["item_id"] or 0, r["text"]) for r in items.collect())
        shared = docs.sparkSession.sparkContext.broadcast(([k if known else None for known, k, _ in got], [t.encode() for _, _, t in got]))

        def run(batches):
            yield from _scan(Items(*shared.value), batches)

        found = docs.mapInArrow(run, SCHEMA)
        # repeated rows of one doc_id are rare and few: the pairs alone are shuffled
        return _longest(found)
    # a number of its own for each item, as ids can be null or repeated
    items = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    lengths = sorted(r["n"] for r in items.select(F.col("item").alias("id"), "text").mapInArrow(_lengths, "n long").distinct().collect())
    seeded = {}
    for kind, frame, key in (("doc", docs, "doc_id"), ("item", items, "item")):
        run, schema = _seed_rows(kind, lengths)
        seeded[kind] = frame.select(F.col(key).alias("id"), "text").mapInArrow(run, schema)
    d, i = seeded["doc"].alias("d"), seeded["item"].alias("i")
    hits = d.join(i, "seed").select(F.col("d.id").alias("doc_id"), F.col("i.id").alias("item"), (F.col("d.at") - F.col("i.at")).alias("shift")).distinct()
    both = hits.join(docs, "doc_id").join(items.withColumnRenamed("text", "words"), "item").select("doc_id", "item_id", F.coalesce("text", F.lit("")).alias("text"), "words", "shift")
    return _longest(both.mapInArrow(_verify, SCHEMA))


def _longest(found: DataFrame) -> DataFrame:
    best = F.max(F.struct(F.col("matched"), (-F.col("start")).alias("before"), F.col("length"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.before")).alias("start"), F.col("b.length").alias("length"), F.col("b.matched").alias("matched"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, without a verified passage. Rows with a null doc_id stay."""
    dirty = overlaps(docs, benchmark).select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(dirty, docs["doc_id"] == dirty["_dirty"], "left_anti")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
