"""Arrow batches as numpy arrays: text slices of bounded size, words, and rolling hashes.

Every Python operator of this subpackage reads texts through ``slices``; texts stay UTF-8 bytes in one
buffer, so that the work on them is vectorised and its memory follows the slice, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. A single longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Odd, so that its powers have inverses modulo 2**64.
_R = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Slice:
    """Rows of one batch: ``ids`` (Arrow, may hold nulls), and texts i as ``data[offs[i]:offs[i+1]]``; null is empty."""

    def __init__(self, batch: pa.RecordBatch, ids: pa.Array, data: np.ndarray, offs: np.ndarray):
        self.batch, self.ids, self.data, self.offs = batch, ids, data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array, null as empty, without a copy of the bytes."""
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.string() else b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), o


def slices(batches, text: str = "text", ids: str = "doc_id", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    for batch in batches:
        data, offs = raw(batch.column(batch.schema.get_field_index(text)))
        key, a = batch.column(batch.schema.get_field_index(ids)), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            b = min(b, batch.num_rows)
            yield Slice(batch.slice(a, b - a), key.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in ``data``, and the index of the first word of each text.

    A word never crosses from one text into the next.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def _powers(n: int, r: int, start: int = 1) -> np.ndarray:
    p = np.full(n, np.uint64(r & (2**64 - 1)), np.uint64)
    if n:
        p[0] = np.uint64(start)
    return np.multiply.accumulate(p)


class Hasher:
    """Polynomial hashes modulo 2**64 of substrings, from prefix sums. ``seed`` picks the values of the symbols."""

    def __init__(self, seed: int):
        self.table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.r = (_R * (2 * seed + 1)) & (2**64 - 1) | 5
        self.inverse = pow(self.r, -1, 2**64)
        self.pw = self.ipw = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pw) < n:
            self.pw, self.ipw = _powers(n, self.r), _powers(n, self.inverse)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums of bytes, or of 64-bit symbols."""
        n = len(symbols)
        self._grow(n + 1)
        p = np.empty(n + 1, np.uint64)
        p[0] = 0
        np.cumsum((self.table[symbols] if symbols.dtype == np.uint8 else symbols) * self.pw[:n], out=p[1:])
        return p

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.ipw[start])

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of ``k`` symbols."""
        n = max(0, len(prefix) - k)
        return mix((prefix[k:] - prefix[:n]) * self.ipw[:n]) if n else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w values, by doubling."""
    out, span = x, 1
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[: len(x) - w + 1], out[w - span : len(x) - span + 1]) if span < w else out


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Boolean for each hash: it is the least of some run of ``w`` consecutive ones. Shorter inputs select nothing.

    Which positions are selected within a run depends on the run alone, so that equal runs select equal positions.
    """
    if len(h) < w:
        return np.zeros(len(h), bool)
    least = _slide(h, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return _slide(padded, w, np.maximum) == h


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binary(data: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Binary array over one buffer."""
    return pa.Array.from_buffers(kind or pa.binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
