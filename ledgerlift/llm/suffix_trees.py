"""Substring dedup by prefix-partitioned suffix trees over words.

``repeats`` brings the pieces that can repeat together. The suffixes of a batch of pieces are split by prefixes of
variable length: a group of suffixes with a common prefix that is over ``GROUP`` splits on one more word, others stay,
so each subtree fits in memory. A subtree is its sorted suffixes with the words that neighbours share: an internal
node is a run of them that shares at least its depth. The highest nodes of depth ``WINDOW`` and more hold the places
of one repeated passage each; every place in a document after the passage's first document is marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import words
from .repeats import WORDS, Pieces, Spec, apply, covered
from .run_length_index import batches, earlier
from .tables import table

#: Words of a passage.
WINDOW = 13
#: Words of the grams whose least hash marks a window.
GRAM = 5
#: Suffixes of a subtree, beyond which its prefix is made longer.
GROUP = 1 << 16


def prefix_groups(s: np.ndarray, at: np.ndarray, limit: int = GROUP, deepest: int = WINDOW):
    """(prefix length, suffix positions): variable-length prefixes so that groups hold ``limit`` suffixes at most.

    Suffixes alike in ``deepest`` symbols aren't split further: they are one deep node.
    """
    waiting = [(0, at)]
    while waiting:
        depth, group = waiting.pop()
        if len(group) <= limit or depth >= deepest:
            yield depth, group
            continue
        symbol = s[np.minimum(group + depth, len(s) - 1)]
        order = np.argsort(symbol, kind="stable")
        edge = np.flatnonzero(symbol[order][1:] != symbol[order][:-1]) + 1
        small: list[np.ndarray] = []
        held = 0
        for part in np.split(group[order], edge):
            if len(part) > limit:
                waiting.append((depth + 1, part))
                continue
            if held + len(part) > limit:  # neighbouring prefixes share a group
                yield depth, np.concatenate(small)
                small, held = [], 0
            small.append(part)
            held += len(part)
        if small:
            yield depth, np.concatenate(small)


def deep_nodes(s: np.ndarray, at: np.ndarray, depth: int):
    """(sorted suffixes, node of each): suffixes under one internal node of at least ``depth``."""
    last = len(s) - 1
    columns = [s[np.minimum(at + d, last)] for d in range(depth)]
    order = np.lexsort(columns[::-1])
    at = at[order]
    shared = np.ones(max(0, len(at) - 1), bool)  # with the suffix above, over the whole depth
    for c in columns:
        x = c[order]
        shared &= x[1:] == x[:-1]
    return at, np.cumsum(np.concatenate([[True], ~shared])) - 1 if len(at) else np.empty(0, np.int64)


def classes(s: np.ndarray, at: np.ndarray, window: int = WINDOW, limit: int = GROUP) -> np.ndarray:
    """For each position in ``at`` a representative of all positions under its node; other positions stand for themselves."""
    head = np.arange(len(s))
    for _, group in prefix_groups(s, at, limit, window):
        sorted_at, node = deep_nodes(s, group, window)
        lead = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        head[sorted_at] = sorted_at[lead][node]
    return head


def index(pieces: Pieces):
    """(windows of each piece, then piece, first and end window of each range seen in an earlier document)."""
    out = [(np.empty(0, np.int64),) * 3]
    windows = np.zeros(len(pieces.contents), np.int64)
    for number in batches(pieces):
        texts = [pieces.contents[i] for i in number]
        buffer = b" ".join(texts)
        data = np.frombuffer(buffer, np.uint8)
        start, end, _ = words(data, np.array([0, len(data)]))
        symbols = np.unique(WORDS.of(WORDS.prefix(data), start, end), return_inverse=True)[1] + 1
        units = np.array([t.count(b" ") + 1 for t in texts])
        s = np.zeros(len(symbols) + len(texts), np.int64)  # a separator 0 after each piece
        s[np.arange(len(symbols)) + np.repeat(np.arange(len(texts)), units)] = symbols
        windows[number] = n = units - WINDOW + 1
        first = np.concatenate([[0], np.cumsum(units + 1)[:-1]])
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append(earlier(units, number, classes(s, at), pieces, WINDOW, True))
    return (windows, *(np.concatenate(x) for x in zip(*out, strict=True)))


def _units(text: bytes):
    data = np.frombuffer(text, np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]))
    if len(start) < WINDOW:
        return start, end, np.empty(0, np.uint64)
    return start, end, WORDS.windows(WORDS.prefix(WORDS.of(WORDS.prefix(data), start, end)), GRAM)


def _content(text: bytes, units, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    joined, at = b" ".join(text.split()), np.concatenate([[0], np.cumsum(units[1] - units[0] + 1)])
    return [joined[a:b] for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist(), strict=True)]


SPEC = Spec(WINDOW, GRAM, _units, _content, index, same_document=True)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_removed", pa.int64())])


def _kept(key: int, text: bytes, ranges: np.ndarray):
    words_ = text.split()  # at 09-0D and 20, which are exactly the separators
    if not ranges.size:
        return key, b" ".join(words_), 0, len(words_)
    gone = covered(ranges, len(words_))
    return key, b" ".join([w for w, g in zip(words_, gone.tolist(), strict=True) if not g]), int(gone.sum()), len(words_)


def _digest(key: int, text: bytes, ranges: np.ndarray):
    _, kept, removed, n = _kept(key, text, ranges)
    return key, n, removed, hashlib.sha256(kept).hexdigest()


def _texts(key: int, text: bytes, ranges: np.ndarray):
    _, kept, removed, _ = _kept(key, text, ranges)
    return key, kept.decode(), removed


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_removed): words covered by a 13-word window that also starts in a document with a smaller doc_id are removed."""
    return apply(docs, SPEC, "doc_id long, kept string, n_removed long", _KEPT, _texts)


def op7_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), SPEC, SCHEMA, _ARROW, _digest)
