"""Context-triggered piecewise hashing.

A hash of the last ``CONTEXT`` bytes triggers the end of a chunk wherever it has ``k`` trailing zero bits, so block sizes
2**k nest. A chunk's own hash gives one character of the signature. The block size is the largest that still gives ``LEAST``
characters; the fingerprint holds the signatures at it and at twice it (``k:signature:signature``). Two fingerprints
are compared where a block size is common, by edit distance (insertions and deletions) over the summed lengths.

A trigger counts from a quarter of the block size after the last one, and in no less than 1 / (8 LEAST) of the text: random
texts have fewer triggers than that anyway, and a text of one letter or a short period, where every place or none triggers,
still gets a signature of at most 8 * LEAST + 1 characters.

Edge cases: null text is empty; the empty text's fingerprint is ``0::``; equal fingerprints compare as 1, and two
without a common block size or with an empty signature otherwise as 0; rows with one ``doc_id`` are ordered by text;
a null ``doc_id`` is ordered last; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Hasher, raw, rows
from .tables import cut, table

CONTEXT = 7
LEAST = 32
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CONTEXT_HASH, _CHUNK_HASH = Hasher(11), Hasher(12)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprint(text: bytes) -> str:
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return "0::"
    h = _CONTEXT_HASH.windows(_CONTEXT_HASH.prefix(data), CONTEXT)
    # chunk ends (exclusive) that any block size of at least 1 can use, with the number of trailing zeros
    zeros = np.bitwise_count((h & (~h + np.uint64(1))) - np.uint64(1)) if len(h) else np.empty(0, np.uint8)
    prefix = _CHUNK_HASH.prefix(data)

    def ends(k: int) -> list[int]:
        least = max((1 << k) // 4, n // (8 * LEAST), 1)
        triggers = (np.flatnonzero(zeros >= k) + CONTEXT).tolist()
        found, i = [], bisect_left(triggers, least)
        while i < len(triggers):
            found.append(triggers[i])
            i = bisect_left(triggers, triggers[i] + least, i + 1)
        if not found or found[-1] != n:
            found.append(n)
        return found

    def signature(at: list[int]) -> str:
        at = np.array(at)
        return _ALPHABET[_CHUNK_HASH.of(prefix, np.concatenate([[0], at[:-1]]), at) >> np.uint64(58)].tobytes().decode()

    k, larger = max(0, (n // LEAST).bit_length()), None
    while len(own := ends(k)) < LEAST and k:
        k, larger = k - 1, own
    return f"{k}:{signature(own)}:{signature(ends(k + 1) if larger is None else larger)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (i, *x), (j, *y) = a.split(":"), b.split(":")
    found = [(x[k - int(i)], y[k - int(j)]) for k in (int(i), int(i) + 1) if 0 <= k - int(j) <= 1]
    # distance of insertions and deletions = both lengths - 2 common
    return max((2 * _common(p, q) / (len(p) + len(q)) for p, q in found if p and q), default=0.0)


def _chars(text: bytes) -> np.ndarray:
    """Byte offset of each code point."""
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of ``text``, and it with the last half's code points replaced by as many first ones of ``following`` (or all)."""
    own = _chars(text)
    n, half = len(own), len(own) // 2
    keep = text[: own[n - half]] if half else text
    head = following[: 4 * half]
    other = _chars(head)
    return n, keep + (head[: other[half]] if len(other) > half else following[: len(head)] if len(other) == half else head)


def _compare(batches):
    """Rows sorted by (bucket, doc_id descending, text); the row after a bucket's last has ``guest`` set and gives no row of its own."""
    held = None

    def step(held, key, text, mark, guest, out):
        if held is not None and held[0] == mark:
            _, doc_id, own, print_own = held
            n, changed = edited(own, text)
            own_next, print_edited = fingerprint(text), fingerprint(changed)
            out.append((doc_id, n, hashlib.sha256(changed).hexdigest(), print_own, print_edited, likeness(print_own, print_edited), likeness(print_own, own_next)))
        else:
            own_next = fingerprint(text)
        return None if guest else (mark, key, text, own_next)

    for batch in batches:
        out: list[tuple] = []
        data, offs = raw(batch.column(3))
        for i, (mark, guest, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            held = step(held, key, data[offs[i] : offs[i + 1]].tobytes(), mark, guest, out)
        yield rows(_ARROW, *(zip(*out, strict=True) if out else [[]] * len(_ARROW)))


def _bucket(order, bounds: list[int]):
    """Number of ``bounds`` (descending) above ``order``, looked up in two steps: blocks of bounds first, then one block's."""
    side = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[a : a + side] for a in range(0, len(bounds), side)]
    above = lambda held: F.size(F.filter(held, lambda b: b > order))
    whole = above(F.array(*(F.lit(x[-1]).cast("long") for x in blocks)))  # blocks that lie above as a whole
    rest = F.get(F.array(*(F.array(*(F.lit(b).cast("long") for b in x)) for x in blocks)), whole)
    return whole * side + F.coalesce(above(rest), F.lit(0))


def neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """Every document with the next one by descending doc_id, fingerprinted and compared. One range shuffle of the texts.

    Buckets are ranges of doc_id, with bounds from quantiles (their number is bounded by ``buckets``). The next of a
    bucket's last document is the first one of the following bucket that has rows: it is sent to both.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("order"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds = sorted({int(x) for x in keyed.where("doc_id is not null").select(F.col("doc_id")).approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}, reverse=True) if buckets > 1 else []
    # buckets run in descending order of doc_id
    keyed = keyed.withColumn("bucket", _bucket(F.col("order"), bounds) if bounds else F.lit(0))
    first = {r["bucket"]: r["top"] for r in keyed.groupBy("bucket").agg(F.max("order").alias("top")).collect()}  # one row a bucket
    if not first:
        return spark.createDataFrame([], SCHEMA)
    used = sorted(first)
    # the first documents of buckets also go to the bucket before; of the first bucket: to the last one
    before = spark.createDataFrame([(first[b], used[i - 1]) for i, b in enumerate(used)], "order long, guest int")
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest"))
    sent = keyed.join(F.broadcast(before), "order", "left").select("doc_id", "text", "order", F.explode(F.when(F.col("guest").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("guest").alias("to"), F.lit(True).alias("guest"))))).alias("x"))
    sent = sent.select(F.col("x.to").alias("to"), F.col("x.guest").alias("guest"), "doc_id", "text", "order")
    parts = min(max(used) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = sent.repartition(parts, "to").sortWithinPartitions("to", "guest", F.desc("order"), "text")
    return dealt.select("to", "guest", "doc_id", "text").mapInArrow(_compare, SCHEMA)


def op8_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neighbours(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # more than tasks, so that these even out
