"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint's 64 bits are three segments (23, 23 and 18 bits). The perfect binary Golay code maps every 23-bit word to
the one codeword within three bits of it: its index (12 bits) is the word's fuzzy hash. Words one bit apart have
different parity, so if even words emit their own index, and odd words also those of their 23 neighbours, equal words
and words one bit apart always share an index.

Up to three differing bits fall on the segments as (0,0,0..3), (0,1,1..2) or (1,1,1). In all but the last one segment
is equal and another differs in at most one bit: keys are (that segment, fuzzy index of the other), six tables. In the
last each segment has an equal half: eight tables of halves. Keys have 30 to 35 bits. Key groups are verified by
counting bits, and each gives links to its components' least members only, so output stays linear in its rows.

Equal fingerprints are one node throughout. Components of up to ``LINKS`` links are joined in one task, those of more in
alternating large-star and small-star rounds, all in shuffles; no links or fingerprints reach the driver.

A key group is compared in full up to ``FULL`` members; a larger one is first split by equal 16-bit quarters (three
differing bits leave one of four equal), which loses no link.

Edge cases: null and empty texts, and texts of separators only, have fingerprint zero and link as any other; rows with
a null doc_id are left out, as they can't name a component; repeated rows are returned each; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, raw, rows, slices
from .tables import cut, table, written

SHINGLE = 3
BITS = 3
SEED = 42
FULL = 4096
#: Links that a task of the component rounds holds at least, but for the last one.
LINKS = 200_000
#: A node with more than one in so many links is sent to the tasks that hold them.
HUBS = 10_000
#: Shingles whose bits are counted at once.
_PART = 1 << 14
#: Fixed value: the generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Hash of each k-word shingle of the lower-cased text, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()  # of bytes: A-Z only, split at 09-0D and 20
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), (ends[min(k, len(words)) - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), _PART):
        ones += np.unpackbits(h[a : a + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    return majority(shingles(text, k))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for s in slices(batches):
            f = np.array([fingerprint(s.text(i), k) for i in range(len(s))], np.uint64)
            yield rows(_FINGERPRINTS, s.ids, f.view(np.int64))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Index of the codeword within three bits of each 23-bit word."""

    def __init__(self):
        # remainders of all words of up to 12 leading bits over the 11 trailing ones
        self.head = np.zeros(4096, np.uint32)
        for i in range(12):
            r = 1 << (11 + i)
            for b in range(22, 10, -1):
                if r >> b & 1:
                    r ^= GOLAY << (b - 11)
            self.head[1 << i : 2 << i] = self.head[: 1 << i] ^ r
        error = np.zeros(2048, np.uint32)
        bit = [1 << i for i in range(23)]
        patterns = np.array([0, *bit, *(a | b for i, a in enumerate(bit) for b in bit[:i]), *(a | b | c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j])], np.uint32)
        error[self.syndrome(patterns)] = patterns
        self.error = error >> np.uint32(11)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.head[x >> np.uint32(11)] ^ (x & np.uint32(2047))

    def index(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint32(11)) ^ self.error[self.syndrome(x)]

    def fuzzy(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index), distinct: words equal or one bit apart, in the low ``width`` bits, share an index."""
        own = self.index(x)
        odd = np.flatnonzero(np.bitwise_count(x) & 1)
        around = self.index(x[odd][:, None] ^ (np.uint32(1) << np.arange(width, dtype=np.uint32))).ravel()
        both = np.unique(np.concatenate([np.arange(len(x)), np.repeat(odd, width)]) << 12 | np.concatenate([own, around]).astype(np.int64))
        return both >> 12, both & 4095


_SEGMENTS = ((0, 23), (23, 23), (46, 18))


def keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): fingerprints within three bits share a key."""
    segment = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.uint32) for a, n in _SEGMENTS]
    found, t = [], 0
    for j, (_, width) in enumerate(_SEGMENTS):
        row, code = golay.fuzzy(segment[j], width)
        for i in range(3):
            if i != j:
                found.append((row, (np.int64(t) << 40) | (segment[i][row].astype(np.int64) << 12) | code))
                t += 1
    half = [(s & np.uint32((1 << n // 2) - 1), s >> np.uint32(n // 2)) for s, (_, n) in zip(segment, _SEGMENTS, strict=True)]
    for choice in range(8):
        x, y, z = (half[i][choice >> i & 1].astype(np.int64) for i in range(3))
        found.append((np.arange(len(fp)), (np.int64(t) << 40) | (x << 24) | (y << 12) | z))
        t += 1
    return np.concatenate([r for r, _ in found]), np.concatenate([k for _, k in found])


def _emit_keys(batches):
    golay = Golay()
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for a in range(0, len(fp), 1 << 13):
            row, key = keys(fp[a : a + (1 << 13)].view(np.uint64), golay)
            yield rows(_KEYS, key, fp[a + row])


def _pairs(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group (sorted group numbers) at most ``bits`` apart."""
    out_a, out_b = [], []
    at, d = np.arange(len(fp)), 1
    while len(at):
        at = at[at + d < len(fp)]
        at = at[group[at] == group[at + d]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
        out_a.append(near)
        out_b.append(near + d)
        d += 1
    return np.concatenate(out_a) if out_a else at, np.concatenate(out_b) if out_b else at


def links(key: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): for each row (sorted by key) linked in its key group, its fingerprint and its component's least row's there."""
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else key
    size = np.bincount(group)[group] if len(key) else key
    a, b = [], []
    small = np.flatnonzero((size > 1) & (size <= FULL))
    x, y = _pairs(group[small], fp[small], bits)
    a.append(small[x])
    b.append(small[y])
    large = np.flatnonzero(size > FULL)
    for shift in (0, 16, 32, 48) if len(large) else ():
        quarter = (fp[large] >> np.uint64(shift)) & np.uint64(0xFFFF)
        order = np.lexsort((quarter, group[large]))
        at = large[order]
        x, y = _pairs((group[at].astype(np.int64) << 16) | quarter[order].astype(np.int64), fp[at], bits)
        a.append(at[x])
        b.append(at[y])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(fp))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _emit_links(batches):
    """Rows sorted by key; a key's rows can cross batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(parts):
        a, b = links(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]).view(np.uint64))
        pair = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0)
        return rows(_LINKS, pair[:, 0], pair[:, 1])

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        end = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if end:
            yield out([*held, (key[:end], fp[:end])])
            held = []
        held.append((key[end:], fp[end:]))
    if held:
        yield out(held)


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(a, b, m) of ``edges`` (a, b) and ``least`` (a, m, n links of a). A node of many links doesn't meet them in one task.

    The nodes with more than one in ``HUBS`` of all links are sent to every task: at most 2 * ``HUBS`` of the ``total`` links' ends.
    """
    least = least.withColumn("hub", F.col("n") * HUBS > total)
    hubs = least.where("hub").select(F.col("a").alias("at"), F.col("m").alias("of"))
    near = edges.join(F.broadcast(hubs), F.col("a") == F.col("at"), "left")
    rest = near.where("at is null").join(least.where("not hub"), "a").select("a", "b", "m")
    return near.where("at is not null").select("a", "b", F.col("of").alias("m")).union(rest)


def _stars(batches):
    """All links of a task -> each node that is not its component's least one there, with that one."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    nodes, at = np.unique(np.concatenate(a + b), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield rows(_LINKS, nodes[moved], nodes[label[moved]])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the least node that it is linked to.

    Each task first joins what its own links connect; up to ``LINKS`` links are in one task, and no round is left to do. Above that,
    large-star and small-star in turn: every round leaves plans and compiled code in the driver.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # few links are shuffled from few tasks: each one leaves a file for every shuffle
    tasks = max(1, -(-now.count() // LINKS))
    now = cut(now.coalesce(tasks).mapInArrow(_stars, "a long, b long"))
    mark = None
    while tasks > 1:
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if found == mark:
            break
        mark, tasks = found, max(2, -(-found[0] // LINKS))
        now = now.coalesce(tasks)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.where("b > a"), least, found[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").coalesce(tasks).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, least, found[0]).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").coalesce(tasks).distinct()
        now = cut(small.coalesce(tasks))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``prints`` (fp, distinct) at most three bits apart."""
    keyed = prints.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_emit_links, "a long, b long")


def groups(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    prints = cut(fingerprints(docs, k))  # two longs a document, read several times
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(linked(nodes))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Of the near-duplicate search: words of a shingle, least Jaccard similarity of shingle sets, parts looked at in each
#: of two partitions of the hash space, and shingles that a part has on average in the coarser one.
NEAR_SHINGLE, NEAR, PARTS, PART_SHINGLES = 5, 0.8, 10, 4
#: Buckets in which shingles are counted, to put rare ones first, and the pieces in which their counts are summed.
BUCKETS, PIECES = 1 << 18, 16
#: Holders of a key that are compared in one place; those of a hotter key are compared as pairs of blocks of about this many.
HOT = 2048
#: Texts that are verified against one other text in one place.
STAR = 256
#: Words of 64 bits to which bitmaps are folded beside the keys.
SMALL = 16
_NEAR_FIELDS = "doc_id long, h long, fp long, node binary, keys array<long>, size int, bits binary, small binary, piece int, counts binary"
_NEAR = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("size", pa.int32()), ("bits", pa.binary()), ("small", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])
_PIECE = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])
_PREFIX = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_APART = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int32())])


def part_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the first parts of a set of shingle hashes, in two partitions of the hash space by its size.

    A key stands for a part's exact content. At similarity 0.8 a part of four shingles is unchanged with odds of about 0.4,
    so that all of ten parts differ in one pair of 170; more similar pairs are missed far less often.
    """
    if not len(h):
        return np.empty(0, np.int64)
    mixed = mix(h)
    level = max(1, int(np.log2(max(1, len(h) / PART_SHINGLES))))
    out = []
    for bits in (level, level + 1):
        part = mixed >> np.uint64(64 - bits)
        low = part < PARTS
        total = np.zeros(PARTS, np.uint64)
        np.add.at(total, part[low].astype(np.int64), mix(mixed[low]))
        used = np.unique(part[low]).astype(np.int64)
        out.append(mix(total[used] * np.uint64(64 * PARTS) + np.uint64(bits * PARTS) + used.astype(np.uint64)).view(np.int64))
    return np.concatenate(out)


def _set(text: bytes) -> np.ndarray:
    return np.unique(shingles(text, NEAR_SHINGLE))


def parity(h: np.ndarray) -> np.ndarray:
    """Bitmap of two to eight bits a shingle; a bit is the parity of how many shingles of the set fall on it.

    Of two sets' bitmaps at most as many bits differ as there are shingles in only one of them: a bound that loses no pair.
    """
    each = 4 if len(h) <= 16 * SMALL else 2
    n = 1 << max(7, (each * len(h) - 1).bit_length() if len(h) else 7)
    return np.packbits(np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1, bitorder="little")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ between two bitmaps, the longer one folded to the shorter one's length."""
    if len(x) != len(y):
        n = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def folded(bits: np.ndarray) -> np.ndarray:
    """A bitmap of at most ``SMALL`` words."""
    return bits if len(bits) <= 8 * SMALL else np.bitwise_xor.reduce(bits.reshape(-1, 8 * SMALL), axis=0)


def _near_prints(batches):
    """A row for each document, and ``PIECES`` for the task with the bucket counts of its sets' shingles."""
    counts = np.zeros(BUCKETS, np.int32)
    for s in slices(batches):
        sets = [_set(s.text(i)) for i in range(len(s))]
        for h in sets:
            np.add.at(counts, (h & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        bits = [parity(h) for h in sets]
        yield rows(_NEAR, s.ids, s.batch.column(2), np.array([majority(h) for h in sets], np.uint64).view(np.int64), [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [part_keys(h) for h in sets], [len(h) for h in sets], [p.tobytes() for p in bits], [folded(p).tobytes() if len(p) > 8 * SMALL else None for p in bits], pa.nulls(len(s), pa.int32()), pa.nulls(len(s), pa.binary()))
    part = counts.reshape(PIECES, -1)
    yield rows(_NEAR, *(pa.nulls(PIECES, f.type) for f in list(_NEAR)[:8]), np.arange(PIECES), [zlib.compress(c.tobytes(), 1) for c in part])


def _sum_pieces(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, np.int64(0)) + np.frombuffer(zlib.decompress(c), np.int32)
    yield rows(_PIECE, list(total), [c.tobytes() for c in total.values()])


def prefix(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the corpus' order, rare buckets first: sets alike by ``NEAR`` share one of them.

    Of sets of n and m shingles at least NEAR * max(n, m) are common, so that the common one that comes first in the order
    has at least NEAR * n - 1 of the set after it.
    """
    need = -int(-(NEAR * len(h) - 1e-9) // 1)  # rounded up
    first = np.lexsort((h, order[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]))[: len(h) - need + 1]
    return h[first]


def _emit_prefixes(order):

    def run(batches):
        rank = order.value
        for s in slices(batches):
            sets = [_set(s.text(i)) for i in range(len(s))]
            first = [prefix(h, rank) for h in sets]
            yield rows(_PREFIX, s.ids, s.batch.column(2), [len(h) for h in sets], [f.view(np.int64) for f in first])

    return run


class Small:
    """Folded bitmaps of rows, as words, and once more folded to half their length: sets that can be alike differ by one halving at most."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.length = np.diff(offs) // 8
        self.full, self.half = (np.zeros((len(self.length), SMALL), np.uint64) for _ in range(2))
        words = data[offs[0] : offs[-1]].copy().view(np.uint64)
        start = (offs[:-1] - offs[0]) // 8
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            own = words[start[at][:, None] + np.arange(n)]
            self.full[at, :n] = own
            self.half[at, : n // 2] = own[:, : n // 2] ^ own[:, n // 2 :]

    def take(self, rows) -> Small:
        new = object.__new__(Small)
        new.length, new.full, new.half = self.length[rows], self.full[rows], self.half[rows]
        return new

    @staticmethod
    def join(parts: list[Small]) -> Small:
        new = object.__new__(Small)
        new.length, new.full, new.half = (np.concatenate([getattr(p, n) for p in parts]) for n in ("length", "full", "half"))
        return new

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits that differ; 0 where lengths are too far apart to tell."""
        m, n = self.length[i], self.length[j]
        x = np.where((m > n)[:, None], self.half[i], self.full[i])
        y = np.where((n > m)[:, None], self.half[j], self.full[j])
        d = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return np.where((m > 2 * n) | (n > 2 * m), 0, d)


def candidates(key: np.ndarray, size: np.ndarray, at: np.ndarray, root: np.ndarray, block: np.ndarray, node: np.ndarray, small: Small, forest: bool) -> np.ndarray:
    """Node pairs of each key group (rows sorted by key and size) that sizes, places and bitmaps let be alike by ``NEAR``.

    ``at`` is the key's place in the set's order: at most min(at) shingles before it and as many as the smaller rest after it
    are common. Nodes of one root are linked already. Rows of a hot key carry a pair of blocks in the key, and ``block`` is
    their own one, or -1 where all pairs of the group are compared. With ``forest`` a group gives only as many pairs as
    join its roots, the closest first.
    """
    found, i, d = [np.empty((0, 3), np.int64)], np.arange(len(key)), 1
    while len(i):
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        i = i[size[i + d] * NEAR <= size[i] + 1e-9]  # sizes only grow with d
        j = i + d
        most = np.minimum(at[i], at[j]) + np.minimum(size[i] - at[i], size[j] - at[j])
        total = size[i].astype(np.int64) + size[j]
        ok = (root[i] != root[j]) & (most * (1 + NEAR) + 1e-9 >= NEAR * total) & ((block[i] < 0) | (block[i] != block[j]))
        p, q, total = i[ok], j[ok], total[ok]
        if len(p):
            bits = small.apart(p, q)
            fit = bits * (1 + NEAR) <= total * (1 - NEAR) + 1e-9
            found.append(np.stack([bits[fit], p[fit], q[fit]], 1))
        d += 1
    found = np.concatenate(found)
    if forest:
        found = found[_forest(found, key, root)]
    x, y = node[found[:, 1]], node[found[:, 2]]
    return np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)


def _forest(found: np.ndarray, key: np.ndarray, root: np.ndarray) -> list[int]:
    """Numbers of the pairs (bits apart, row, row) that join roots of a key group which closer pairs haven't joined."""
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    kept = []
    for n in np.argsort(found[:, 0], kind="stable").tolist():
        _, i, j = found[n].tolist()
        k = int(key[i])
        a, b = top((k, int(root[i]))), top((k, int(root[j])))
        if a != b:
            up[a] = b
            kept.append(n)
    return kept


def _emit_candidates(forest: bool):
    """Rows sorted by key and size; a key's rows can cross batches."""

    def run(batches):
        held: list[tuple[list[np.ndarray], Small]] = []

        def out(parts):
            pairs = candidates(*(np.concatenate(x) for x in zip(*(c for c, _ in parts), strict=True)), Small.join([x for _, x in parts]), forest)
            return rows(_PAIRS, pairs[:, 0], pairs[:, 1])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(6)]
            key = columns[0]
            if not len(key):
                continue
            small = Small(*raw(batch.column(6)))
            end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0  # the last key may go on
            if end or held and held[0][0][0][0] != key[0]:
                yield out([*held, ([c[:end] for c in columns], small.take(slice(0, end)))])
                held = []
            held.append(([c[end:] for c in columns], small.take(slice(end, None))))
        if held:
            yield out(held)

    return run


def _close_enough(batches):
    """Pairs with both sides' sizes and bitmaps -> those that can be alike by ``NEAR``, with the bits that differ."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
        (s, i), (t, j) = (raw(batch.column(c)) for c in (4, 5))
        d = np.zeros(batch.num_rows, np.int32)
        for r in np.flatnonzero(np.minimum(n, m) + 1e-9 >= NEAR * np.maximum(n, m)).tolist():
            d[r] = apart(s[i[r] : i[r + 1]], t[j[r] : j[r + 1]])
        fit = (np.minimum(n, m) + 1e-9 >= NEAR * np.maximum(n, m)) & (d * (1 + NEAR) <= (n + m) * (1 - NEAR) + 1e-9)
        yield rows(_APART, *(batch.column(c).filter(pa.array(fit)) for c in (0, 1)), d[fit])


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, apart) of those node pairs that the bitmaps of their sets let be alike: no text is moved for the others."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    return both.mapInArrow(_close_enough, "a long, b long, apart int")


def _similar(batches):
    """Rows sorted by (b, block, a): a block's first row, with a null ``a``, has the text that its others are compared with."""
    place, own, last = None, None, None
    for batch in batches:
        t, at = raw(batch.column(3))
        found = []
        for r, (b, block, a) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if a is None:
                if place != (b, block):
                    place, own, last = (b, block), _set(t[at[r] : at[r + 1]].tobytes()), None
            elif a != last:  # a repeated row is verified once
                last, q = a, _set(t[at[r] : at[r + 1]].tobytes())
                both = len(np.intersect1d(own, q, assume_unique=True))
                if both >= NEAR * (len(own) + len(q) - both):
                    found.append((a, b))
        yield rows(_PAIRS, *(zip(*found, strict=True) if found else [[], []]))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The node pairs (a, b) whose shingle sets are alike by ``NEAR``, by the whole texts.

    Texts move once: that of a to its pair's b, that of b to each block of at most about ``STAR`` pairs.
    """
    pairs = written(pairs.select("a", "b"))
    blocks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("blocks"))
    asks = pairs.join(blocks, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "a")
    owns = blocks.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("a"))
    # a small table of wanted rows is broadcast, so that only their texts move
    wanted = written(asks.unionByName(owns).join(nodes.select("node", "doc_id", "h"), "node").select("doc_id", "h", "b", "block", "a"))
    sent = wanted.join(docs, ["doc_id", "h"]).select("b", "block", "a", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "b", "block").sortWithinPartitions("b", "block", F.asc_nulls_first("a")).mapInArrow(_similar, "a long, b long")


def _mixed(entries: DataFrame) -> DataFrame:
    """(key, blocks) of the keys in ``entries`` whose holders aren't all of one root."""
    keys = entries.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"))
    return keys.where("x != y").select("key", F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))


def _candidates(index: DataFrame, roots: DataFrame, nodes: DataFrame, forest: bool) -> DataFrame:
    """Distinct node pairs (a, b) of ``index`` (key, node, size, at) that can be alike and whose ``roots`` (node, root) differ."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    index = index.join(_mixed(index), "key").join(nodes.select("node", F.coalesce("small", "bits").alias("small")), "node")
    index = index.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    index = index.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    index = index.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(pair).alias("key"), "size", "at", "root", F.when((F.col("own") == F.col("other")) | (F.col("blocks") == 1), F.lit(-1)).otherwise(F.col("own")).cast("int").alias("block"), "node", "small")
    return index.repartition(n, "key").sortWithinPartitions("key", "size").mapInArrow(_emit_candidates(forest), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of documents that are near copies of another: five-word shingle sets alike by 0.8 or more.

    Documents with equal sets are one node. A first search is linear in the rows and links most copies: fingerprints at most
    three bits apart through the Golay keys, and the least holder of each part's exact content; of a node's candidates there
    the closest one is tried. The second is exact: an inverted index of prefixes (``prefix``) gives all pairs that can be
    alike by 0.8 and that the first hasn't linked. Candidates whose bitmaps rule out 0.8 (``parity``) go; every other one
    is verified by the Jaccard similarity of the whole texts' sets.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = written(docs.mapInArrow(_near_prints, _NEAR_FIELDS))
    counts = np.zeros((PIECES, BUCKETS // PIECES), np.int64)
    for r in found.where("piece is not null").select("piece", "counts").repartition(PIECES, "piece").mapInArrow(_sum_pieces, "piece int, counts binary").collect():  # of fixed size
        counts[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    # finer than a factor of two is not needed, and a byte each is sent
    order = docs.sparkSession.sparkContext.broadcast(np.log2(counts.ravel() + 1).astype(np.uint8))
    prints = found.where("piece is null").drop("piece", "counts")
    nodes = prints.groupBy(F.col("node").alias("set")).agg(F.min(F.struct("doc_id", "h")).alias("m"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("small").alias("small"))
    # a number of its own for each set, and for the set the row that stands for it
    nodes = written(nodes.select("set", F.monotonically_increasing_id().alias("node"), "m.doc_id", "m.h", "fp", "keys", "size", "bits", "small"))

    fps = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    close = linked(fps)
    same = nodes.join(fps.withColumnRenamed("first", "least"), "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    close = close.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    asked = keyed.join(least, "key").where("node != b").select(F.col("node").alias("a"), "b")
    possible = _possible(close.unionByName(same).unionByName(asked).distinct(), nodes)
    first = written(_verified(possible.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")), nodes, docs))

    listed = docs.mapInArrow(_emit_prefixes(order), "doc_id long, h long, size int, keys array<long>").join(nodes.select("node", "doc_id", "h"), ["doc_id", "h"]).dropDuplicates(["node"])
    roots = components(first)
    listed = written(listed.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "keys"))
    entries = listed.select("node", "root", "size", F.posexplode("keys").alias("at", "key"))
    mixed = written(_mixed(entries).select("key"))  # as its size is known then, it is broadcast where small
    index = written(entries.drop("root").join(mixed, "key"))
    forest = written(_verified(_possible(_candidates(index, roots, nodes, True), nodes), nodes, docs))
    star = lambda found: found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(star(roots).unionByName(forest))
    rest = _verified(_possible(_candidates(index, roots, nodes, False), nodes), nodes, docs)

    roots = components(star(roots).unionByName(rest))
    placed = nodes.join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("root"), "doc_id")
    named = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", F.col("node").alias("set")).join(placed.select("set", "root"), "set").join(named, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each near-duplicate group the one with the least doc_id. Rows with a null doc_id stay."""
    gone = cut(near_duplicates(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
