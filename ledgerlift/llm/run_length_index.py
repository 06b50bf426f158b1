"""Suffix-array dedup through a run-length index.

``repeats`` brings the pieces of text that can repeat together, in buckets of bounded size. For each batch of
pieces a Burrows-Wheeler transform is built and kept as runs only. At every run's start the index keeps two samples of the
suffix array, its own row and the end of the run before, and how many bytes the two suffixes share. All other rows
follow: within a run, one step to the right in the text moves both suffixes on by one and shortens what they share by
one. So a left-to-right stream over the text yields, for every position, the length of its longest match with the
lexicographic neighbour above, and where that is: its matching statistics. Windows linked by matches of at least
``WINDOW`` bytes are equal; all but the earliest of such a class are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import BYTES, Pieces, Spec, apply, covered
from .tables import table

#: Bytes of a passage.
WINDOW = 100
#: Bytes of the grams whose least hash marks a window.
GRAM = 20
#: Bytes of pieces that one index holds, but for pieces of one mark.
INDEX_BYTES = 1 << 19


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols: sorted by packed prefixes first, then by doubling where suffixes still tie."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    symbol = s.astype(np.uint64) + np.uint64(1)  # 0 is the end, which sorts before every symbol
    bits = int(symbol.max()).bit_length()
    span = min(n, max(1, 64 // bits))
    key = np.zeros(n, np.uint64)
    for j in range(span):
        key <<= np.uint64(bits)
        key[: n - j] |= symbol[j:]
    sa = np.argsort(key)
    edge = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, n))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(first, size)
    rank[n] = -1
    tied = np.flatnonzero(np.repeat(size > 1, size))
    while len(tied):
        at = sa[tied]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + span, n)] + 1
        order = np.argsort(pair)
        at, pair = at[order], pair[order]
        sa[tied] = at
        edge = np.concatenate([[True], pair[1:] != pair[:-1]])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        span *= 2
    return sa


def _shared(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    n, out = len(s), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        live = live[(x < n) & (y < n) & (s[np.minimum(x, n - 1)] == s[np.minimum(y, n - 1)])]
        out[live] += 1
    return out


class RunLengthIndex:
    """Runs of the transform of ``s`` and, for each run's start: its text position, the row above's, and what they share."""

    def __init__(self, s: np.ndarray):
        sa = suffix_array(s)
        before = np.where(sa > 0, s[sa - 1].astype(np.int64), -1)
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.n = len(s)
        self.symbols, self.lengths = before[head], np.diff(np.append(head, len(s)))
        at, above = sa[head], sa[head - 1]  # of row 0 there is none above: it shares nothing
        order = np.argsort(at)
        self.at, self.above = at[order], above[order]
        shared = np.zeros(len(head), np.int64)
        shared[1:] = _shared(s, at[1:], above[1:])
        self.shared = shared[order]

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position the longest match with the suffix above its own, and that suffix's position."""
        i = np.arange(self.n)
        k = np.searchsorted(self.at, i, "right") - 1
        step = i - self.at[k]
        length = np.maximum(self.shared[k] - step, 0)
        return length, np.where(length > 0, self.above[k] + step, i)


def classes(s: np.ndarray, window: int) -> np.ndarray:
    """For each text position a representative of all positions whose next ``window`` symbols are equal."""
    length, above = RunLengthIndex(s).matching_statistics()
    head = np.where(length >= window, above, np.arange(len(s)))
    while True:
        further = head[head]
        if (further == head).all():
            return head
        head = further


def batches(pieces: Pieces, limit: int = INDEX_BYTES):
    """Piece numbers by mark, cut between marks once ``limit`` bytes are together."""
    order = np.argsort(pieces.marks, kind="stable")
    size = np.array([len(pieces.contents[i]) for i in order])
    mark = pieces.marks[order]
    begin = total = 0
    for i in range(len(order)):
        if total >= limit and mark[i] != mark[i - 1]:
            yield order[begin:i]
            begin, total = i, 0
        total += size[i]
    if begin < len(order):
        yield order[begin:]


def earlier(units: np.ndarray, number: np.ndarray, head_of, pieces: Pieces, window: int, by_document: bool):
    """Ranges of windows of each piece of a batch whose class has an earlier first place (in a smaller document, if ``by_document``)."""
    start = np.concatenate([[0], np.cumsum(units + 1)[:-1]])  # of each piece in the batch's text; one separator each
    n = units - window + 1
    piece = np.repeat(np.arange(len(number)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    head = head_of[start[piece] + offset]
    doc, where = pieces.doc[number[piece]], pieces.start[number[piece]] + offset
    _, cls, count = np.unique(head, return_inverse=True, return_counts=True)
    many = np.flatnonzero(count[cls] > 1)
    order = many[np.lexsort((where[many], doc[many], cls[many]))]
    first = np.concatenate([[True], cls[order][1:] != cls[order][:-1]]) if len(order) else np.empty(0, bool)
    lead = order[np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(order))))]
    old = doc[order] > doc[lead] if by_document else (doc[order] > doc[lead]) | (where[order] > where[lead])
    seen = np.zeros(len(piece), bool)
    seen[order[old]] = True
    edge = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(piece) else np.empty(0, bool)
    begin = np.flatnonzero(seen & (edge | ~np.concatenate([[False], seen[:-1]])))
    last = np.concatenate([edge[1:], [True]])
    end = np.flatnonzero(seen & (last | ~np.concatenate([seen[1:], [False]])))
    return number[piece[begin]], offset[begin], offset[end] + 1


def index(pieces: Pieces):
    """(windows of each piece, then piece, first and end window of each range seen earlier)."""
    out = [(np.empty(0, np.int64),) * 3]
    for number in batches(pieces):
        text = [pieces.contents[i] for i in number]
        s = np.frombuffer(b"\xff".join([*text, b""]), np.uint8) + np.uint8(1)  # 0xFF isn't in UTF-8: separators are 0
        units = np.array([len(t) for t in text])
        out.append(earlier(units, number, classes(s, WINDOW), pieces, WINDOW, False))
    windows = np.array([len(t) for t in pieces.contents]) - WINDOW + 1
    return (windows, *(np.concatenate(x) for x in zip(*out, strict=True)))


def _units(text: bytes):
    data = np.frombuffer(text, np.uint8)
    return (BYTES.windows(BYTES.prefix(data), GRAM) if len(text) >= WINDOW else np.empty(0, np.uint64),)


def _content(text: bytes, units, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


SPEC = Spec(WINDOW, GRAM, _units, _content, index, same_document=False)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
KEPT_SCHEMA = "doc_id long, kept binary, n_removed long, spans array<struct<start: long, end: long>>"
_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _spans(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _digest(key: int, text: bytes, ranges: np.ndarray):
    if not ranges.size:
        return key, len(text), 0, 0, hashlib.sha256(text).hexdigest()
    gone = covered(ranges, len(text))
    return key, len(text), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def _kept(key: int, text: bytes, ranges: np.ndarray):
    gone = covered(ranges, len(text))
    starts, ends = _spans(gone)
    return key, np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_removed, spans): every byte removed that a 100-byte string seen earlier covers. ``kept`` is bytes: a cut can fall inside a character."""
    return apply(docs, SPEC, KEPT_SCHEMA, _KEPT, _kept)


_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _text(key: int, text: bytes, ranges: np.ndarray):
    return key, np.frombuffer(text, np.uint8)[~covered(ranges, len(text))].tobytes().decode("utf-8", "ignore")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the repeats cut out of ``text`` and ``n_chars`` (if there) counted anew.

    A character of which a cut leaves a part goes too. All rows stay, those with a null doc_id as they are.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = apply(docs, SPEC, "doc_id long, text string", _TEXT, _text, carry)
    back = {c: F.col(f"carried_{c}") for c in carry} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in carry:
        back["n_chars"] = F.length("text")
    kept = found.select(*(back[f.name].cast(f.dataType).alias(f.name) for f in docs.schema))
    return kept.unionByName(docs.where("doc_id is null"))


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), SPEC, SCHEMA, _ARROW, _digest)
