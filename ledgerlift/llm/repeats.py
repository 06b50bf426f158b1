"""Bringing together all places where long passages repeat, in a few linear shuffles.

A window is ``spec.window`` consecutive units (bytes or words) of one document. Its mark is the least hash among the
``spec.gram``-unit grams inside it, which depends on the window alone; a run of windows with one mark is a piece.

1. ``texts``: documents dealt to groups of bounded bytes by a hash of doc_id. The one shuffle of whole texts; the
   later steps read it again (Spark reuses the exchange).
2. Marks: every group sends the distinct marks of its documents, eight bytes each, to the mark's bucket.
3. A bucket tells each group which of its marks also occur elsewhere (a false alarm costs time, not correctness).
4. Pieces: a group cuts the pieces with such marks, once for each distinct content, with all places where it occurs.
   A hot passage is therefore sent once a group, however often it occurs there.
5. ``spec.index`` gets a bucket's distinct pieces and says which windows of a piece were seen earlier.
6. The marked ranges go back to the groups, and ``finish`` turns each document and its ranges into a row.

Windows never leave their piece, and equal windows always meet in one bucket, so the outcome is exact.

Memory: a group holds about ``GROUP_BYTES`` of text (or one longer document); a bucket's pieces are indexed in
batches that end between marks.

Edge cases: rows with a null doc_id can't be ordered or reported and are left out; rows that repeat a doc_id are parts of one
document, distinct texts one after the other in the order of their bytes, and each row is returned, equal rows with equal
results; null text is empty; texts shorter than a window have none.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Hasher, _slide, minimizers, raw

#: Bytes of text of a group of documents; a bucket is as many bytes of marks or pieces at most, roughly.
GROUP_BYTES = 4 << 20


@dataclass(frozen=True)
class Spec:
    """``units`` gives of a text its unit hashes' prefix sums' windows: (number of units, unit starts, unit ends, gram hashes)."""

    window: int
    gram: int
    units: Callable
    content: Callable
    index: Callable
    same_document: bool


def documents(table: pa.Table) -> list[tuple[int, bytes, int, list[int]]]:
    """(doc_id, text, base, rows) of a group, in order; equal rows are one.

    Texts that share a doc_id are laid one after the other, in the order of their bytes: ``base`` is the unit at which one begins.
    """
    out: dict[tuple[int, bytes], list[int]] = {}
    at = 0
    for batch in table.to_batches():
        data, offs = raw(batch.column(batch.schema.get_field_index("text")))
        for i, key in enumerate(batch.column(batch.schema.get_field_index("doc_id")).to_pylist()):
            out.setdefault((key, data[offs[i] : offs[i + 1]].tobytes()), []).append(at + i)
        at += batch.num_rows
    found, base, last = [], 0, None
    for key, text in sorted(out):
        base = base if key == last else 0
        found.append((key, text, base, out[key, text]))
        base, last = base + len(text) + 1, key  # a text has no more units than bytes
    return found


def runs(gram_hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and mark of each run of windows with one mark."""
    if len(gram_hashes) < w:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    least = _slide(gram_hashes, w, np.minimum)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return start, np.diff(np.append(start, len(least))), least[start]


def _split(bucket: np.ndarray):
    """Index arrays of equal buckets."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _mark(spec: Spec, buckets: int):
    """Group -> (bucket, g, marks, repeated): its distinct marks, and whether one occurs twice in the group already."""
    w = spec.window - spec.gram + 1

    def run(table: pa.Table) -> pa.Table:
        found = [np.empty(0, np.uint64)]
        for _, text, _, _ in documents(table):
            grams = spec.units(text)[-1]
            found.append(grams[minimizers(grams, w)])  # each place, so that windows which repeat close together show
        marks, counts = np.unique(np.concatenate(found), return_counts=True)
        twice = counts > 1
        out = [(b, marks[at].tobytes(), twice[at].astype(np.uint8).tobytes()) for b, at in _split((marks % np.uint64(buckets)).astype(np.int64))]
        g = table.column("g")[0].as_py()
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "g": pa.array([g] * len(out), pa.int64()), "marks": pa.array([x[1] for x in out], pa.binary()), "twice": pa.array([x[2] for x in out], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Bucket -> (g, marks): for each group its marks that occur elsewhere too."""
    groups = table.column("g").to_pylist()
    marks = [np.frombuffer(x, np.uint64) for x in table.column("marks").to_pylist()]
    twice = np.frombuffer(b"".join(table.column("twice").to_pylist()), np.bool_)
    owner = np.repeat(np.arange(len(marks)), [len(x) for x in marks])
    values = np.concatenate(marks)
    order = np.argsort(values, kind="stable")
    v = values[order]
    edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.append(edge, len(v)))
    again = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], edge), size)
    keep = order[again]
    out = [(groups[k], values[keep[at]].tobytes()) for k, at in _split(owner[keep])]
    return pa.table({"g": pa.array([x[0] for x in out], pa.int64()), "marks": pa.array([x[1] for x in out], pa.binary())})


_PIECES = "bucket long, g long, marks binary, sizes binary, contents binary, piece binary, doc binary, start binary"


def _cut(spec: Spec, buckets: int):
    """(Group's documents, its repeated marks) -> for each bucket the distinct pieces and their places."""
    w = spec.window - spec.gram + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right.column("marks").to_pylist())]))
        known: dict[bytes, int] = {}
        marks: list[int] = []
        piece: list[int] = []
        doc: list[np.ndarray] = []
        where: list[np.ndarray] = []
        for key, text, base, _ in documents(left) if len(wanted) else []:
            units = spec.units(text)
            start, n, mark = runs(units[-1], w)
            at = np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == mark)
            if not len(hit):
                continue
            for content, m in zip(spec.content(text, units, start[hit], start[hit] + n[hit] - 1 + spec.window), mark[hit].tolist(), strict=True):
                k = known.setdefault(content, len(known))
                if k == len(marks):
                    marks.append(m)
                piece.append(k)
            doc.append(np.full(len(hit), key, np.int64))
            where.append(start[hit].astype(np.int64) + base)
        contents = list(known)
        out = []
        if contents:
            m, p, d, s = np.array(marks, np.uint64), np.array(piece, np.int64), np.concatenate(doc), np.concatenate(where)
            bucket = (m % np.uint64(buckets)).astype(np.int64)
            of_place = dict(_split(bucket[p]))
            local = np.empty(len(m), np.int32)
            for b, at in _split(bucket):
                local[at] = np.arange(len(at), dtype=np.int32)
                places = of_place[b]
                out.append((b, m[at].tobytes(), np.array([len(contents[i]) for i in at], np.int32).tobytes(), b"".join([contents[i] for i in at]), local[p[places]].tobytes(), d[places].tobytes(), s[places].tobytes()))
        g = left.column("g")[0].as_py() if left.num_rows else 0
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table({"bucket": pa.array(columns[0], pa.int64()), "g": pa.array([g] * len(out), pa.int64())} | {name: pa.array(c, pa.binary()) for name, c in zip(("marks", "sizes", "contents", "piece", "doc", "start"), columns[1:], strict=True)})

    return run


@dataclass
class Pieces:
    """Distinct pieces of a bucket by mark, each with the (doc, start) where it occurs first."""

    contents: list[bytes]
    marks: np.ndarray
    doc: np.ndarray
    start: np.ndarray


def _seen(spec: Spec):
    """Bucket -> (g, ranges): for each group, the (doc, first unit, end unit) that windows seen earlier cover."""

    def run(table: pa.Table) -> pa.Table:
        groups = table.column("g").to_pylist()
        known: dict[bytes, int] = {}
        marks: list[int] = []
        piece, doc, start, owner = [], [], [], []
        for r, (m, sizes, contents, p, d, s) in enumerate(zip(*(table.column(c).to_pylist() for c in ("marks", "sizes", "contents", "piece", "doc", "start")), strict=True)):
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
            ids = []
            for a, b, mark in zip([0, *ends[:-1]], ends, np.frombuffer(m, np.uint64).tolist(), strict=True):
                k = known.setdefault(contents[a:b], len(known))
                if k == len(marks):
                    marks.append(mark)
                ids.append(k)
            piece.append(np.array(ids, np.int64)[np.frombuffer(p, np.int32)])
            doc.append(np.frombuffer(d, np.int64))
            start.append(np.frombuffer(s, np.int64))
            owner.append(np.full(len(piece[-1]), r, np.int64))
        p, d, s, o = (np.concatenate(x) for x in (piece, doc, start, owner))
        order = np.lexsort((s, d, p))
        first = order[np.concatenate([[True], p[order][1:] != p[order][:-1]])]  # of each piece, in the order of its number
        pieces = Pieces(list(known), np.array(marks, np.uint64), d[first], s[first])
        units, number, begin, end = spec.index(pieces)  # windows of each piece; ranges of windows seen earlier at its first place
        # a later place of a piece is covered whole; the first (or all of the first document) as the index says
        same = (d == pieces.doc[p]) & (spec.same_document | (s == pieces.start[p]))
        later = np.flatnonzero(~same)
        rd, rb, re_, ro = [d[later]], [s[later]], [s[later] + units[p[later]] - 1 + spec.window], [o[later]]
        if len(number):
            at = np.flatnonzero(same)
            at = at[np.argsort(p[at], kind="stable")]
            lo, hi = np.searchsorted(p[at], number), np.searchsorted(p[at], number, "right")
            each = np.repeat(np.arange(len(number)), hi - lo)
            place = at[np.repeat(lo, hi - lo) + np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
            rd.append(d[place])
            rb.append(s[place] + begin[each])
            re_.append(s[place] + end[each] - 1 + spec.window)
            ro.append(o[place])
        rd, rb, re_, ro = (np.concatenate(x) for x in (rd, rb, re_, ro))
        out: dict[int, list] = defaultdict(list)
        for r, at in _split(ro):
            out[groups[r]].append(np.stack([rd[at], rb[at], re_[at]]))
        return pa.table({"g": pa.array(list(out), pa.int64()), "ranges": pa.array([np.concatenate(x, axis=1).tobytes() for x in out.values()], pa.binary())})

    return run


def covered(ranges: np.ndarray, n: int) -> np.ndarray:
    """Boolean for each of n units: some range covers it."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, ranges[0], 1)
    np.add.at(edge, ranges[1], -1)
    return np.cumsum(edge[:n]) > 0


def _finish(spec: Spec, schema: pa.Schema, row: Callable, carry: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.int64).reshape(3, -1) for x in right.column("ranges").to_pylist()]
        ranges = np.concatenate([np.empty((3, 0), np.int64), *parts], axis=1)
        ranges = ranges[:, np.argsort(ranges[0], kind="stable")]
        out, at = [], []
        for key, text, base, own in documents(left):
            a, b = np.searchsorted(ranges[0], [key, key + 1])
            mine = ranges[1:, a:b]
            mine = mine[:, (mine[0] >= base) & (mine[0] <= base + len(text))] - base
            out.extend([row(key, text, mine)] * len(own))
            at.extend(own)
        found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)
        for name in carry:
            found = found.append_column(f"carried_{name}", left.column(f"carried_{name}").take(pa.array(at, pa.int64())))
        return found

    return run


def groups_of(docs: DataFrame) -> int:
    """Groups of documents, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / GROUP_BYTES))


def apply(docs: DataFrame, spec: Spec, schema: str, arrow: pa.Schema, row: Callable, carry: list[str] | None = None) -> DataFrame:
    """A row ``row(doc_id, text, ranges)`` for each document; ``ranges`` are [starts, ends] in units, overlapping and in any order.

    ``carry`` names further columns of docs that the rows keep, as ``carried_<name>``.
    """
    n, carry = groups_of(docs), carry or []
    texts = docs.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    parts = max(1, min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    texts = texts.repartition(parts, "g")
    marks = texts.groupBy("g").applyInArrow(_mark(spec, n), "bucket long, g long, marks binary, twice binary")
    again = marks.groupBy("bucket").applyInArrow(_repeated, "g long, marks binary")
    pieces = texts.groupBy("g").cogroup(again.groupBy("g")).applyInArrow(_cut(spec, n), _PIECES)
    ranges = pieces.groupBy("bucket").applyInArrow(_seen(spec), "g long, ranges binary")
    full = ", ".join([schema, *(f"carried_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)])
    return texts.groupBy("g").cogroup(ranges.groupBy("g")).applyInArrow(_finish(spec, arrow, row, carry), full)


#: Hashes of bytes, and of words as symbols.
BYTES, WORDS = Hasher(21), Hasher(22)
