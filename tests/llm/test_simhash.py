import random

import brute
import numpy as np

from ledgerlift.llm import simhash as S


def test_golay_code_is_perfect():
    g = S.Golay()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 4000).astype(np.uint32)
    index = g.index(x)
    code = np.array([next(c for c in [int(i) << 11 | r for r in [int(g.syndrome(np.array([int(i) << 11], np.uint32))[0])]]) for i in index], np.uint32)
    assert (np.bitwise_count(code ^ x) <= 3).all() and (g.syndrome(code) == 0).all()
    row, keys = g.fuzzy(x[:300], 23)
    own = {i: set(keys[row == i].tolist()) for i in range(300)}
    for b in range(23):
        row, keys = g.fuzzy(x[:300] ^ np.uint32(1 << b), 23)
        assert all(own[i] & set(keys[row == i].tolist()) for i in range(300))


def test_fingerprints_three_bits_apart_share_a_key():
    g, rng = S.Golay(), random.Random(1)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        x, y = (set(S.keys(np.array([v], np.uint64), g)[1].tolist()) for v in (a, b))
        assert x & y


def test_links_keep_components_in_large_groups(monkeypatch):
    monkeypatch.setattr(S, "FULL", 8)
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 7, 60).astype(np.uint64) << np.uint64(40))
    key = np.zeros(len(fp), np.int64)

    def roots(pairs):
        parent = {int(f): int(f) for f in fp}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in pairs:
            x, y = find(int(a)), find(int(b))
            parent[max(x, y)] = min(x, y)
        return {v: find(v) for v in parent}

    want = roots([(a, b) for a in fp for b in fp if (int(a) ^ int(b)).bit_count() <= 3])
    assert roots(zip(*S.links(key, fp), strict=True)) == want


def test_odd_texts(documents, odd, texts):
    got = {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in S.groups(documents([*odd, (None, "left out")])).collect()}
    assert got == brute.simhash_components(texts)


def test_registered_query(spark, sf_dir):
    plain = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op5_golay_simhash(spark, sf_dir).collect()}
    assert got == brute.simhash_components(plain)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (200, 200)]
    got = dict(tuple(r) for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: got.get(k, k) for k in range(61)} == dict.fromkeys(range(61), 0) and got[100] == got[95] == 90 and 200 not in got


def test_components_are_the_same_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(30)]
    up = {v: v for e in edges for v in e}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    links = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for most in (S.LINKS, 50):
        monkeypatch.setattr(S, "LINKS", most)
        got = dict(tuple(r) for r in S.components(links).collect())
        assert {v: got.get(v, v) for v in up} == {v: top(v) for v in up}
    assert S.components(links.where("a is null")).collect() == []


def test_components_of_few_links_need_no_rounds(spark):
    """Each round leaves plans and compiled code in the driver: a chain of 60 took eight of them."""
    context = spark.sparkContext
    context.setJobGroup("few links", "")
    try:
        S.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()
        assert len(context.statusTracker().getJobIdsForGroup("few links")) <= 12
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_near_duplicates(documents, spark, sf_dir):
    rng = random.Random(7)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]
    pairs, k = [(None, "kept"), (900, None), (901, ""), (902, "a b"), (903, "a b")], 0
    for n in (12, 60, 300):
        for _ in range(6):
            base = say(n)
            pairs.append((k, " ".join(base)))
            for edits in (0, 1, max(1, n // 80)):
                words = list(base)
                for at in rng.sample(range(n), edits):
                    words[at] = "new" + str(rng.random())
                k += 1
                pairs.append((k, " ".join(words)))
            k += 1
    docs = documents(pairs)
    plain = {i: (t or "").encode() for i, t in pairs if i is not None}
    assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs).collect()} == brute.near_components(plain)
    kept = {r["doc_id"] for r in S.keep_one(docs).collect()}
    assert kept == {i for i, c in brute.near_components(plain).items() if i == c} | {None}
    plain = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()} == brute.near_components(plain)


def variants(rng, n, edits, count, tag):
    base = [f"{tag}{rng.randint(0, 10**6)}" for _ in range(n)]
    out = []
    for i in range(count):
        words = list(base)
        for at in rng.sample(range(n), edits):
            words[at] = f"{tag}new{i}x{at}"
        out.append(" ".join(words))
    return " ".join(base), out


def test_near_duplicates_around_a_base_that_is_not_the_least(documents, monkeypatch):
    """Copies edited on their own are alike to their base by 0.8 and less to each other: only its links join them."""
    rng, pairs = random.Random(11), []
    for g, (count, place) in enumerate([(40, 20), (19, 19), (4, 2), (4, 4)]):
        base, others = variants(rng, 200, 3, count, f"g{g}v")
        pairs += [(1000 * g + i, t) for i, t in enumerate([*others[:place], base, *others[place:]])]
    plain = {i: t.encode() for i, t in pairs}
    want = brute.near_components(plain)
    assert set(want.values()) == {0, 1000, 2000, 3000}
    for hot in (S.HOT, 8):
        monkeypatch.setattr(S, "HOT", hot)
        assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(documents(pairs)).collect()} == want


def test_sets_alike_share_a_prefix():
    rng = np.random.default_rng(9)
    order = rng.integers(0, 20, S.BUCKETS).astype(np.uint8)
    for n in (1, 4, 5, 9, 40, 200):
        for both in range(n + 1):
            h = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            a, b = h[:n], np.concatenate([h[:both], h[n:]])
            if both >= S.NEAR * (len(a) + len(b) - both) or both >= S.NEAR * n:
                b = np.sort(b[: max(both, 1)])
                assert np.intersect1d(S.prefix(np.sort(a), order), S.prefix(b, order)).size


def test_empty_table(documents):
    docs = documents([(1, "x")]).where("doc_id < 0")
    assert S.groups(docs).collect() == [] and S.keep_one(docs).collect() == []
