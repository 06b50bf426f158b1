"""Decontamination, toxicity, language, packing, fingerprints, language-model scores and shards."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import brute
import numpy as np
import pytest
from oracle import duck, spark_rows
from tokenizers import Tokenizer

from ledgerlift.llm import attention, decontamination, fingerprints, language, lm_scoring, packing, queries, sharding, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture
def none(documents):
    return documents([(1, "x")]).where("doc_id < 0")


# decontamination


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, seed long")


def test_verbatim_and_substituted_passages_are_found(spark, documents):
    rng = random.Random(1)
    say = lambda n: [f"t{rng.randint(0, 5000)}" for _ in range(n)]
    items = {i: say(n) for i, n in enumerate((40, 30, 20, 16, 15, 9, 6, 3))}
    swap = lambda ws, *at: ["other" if i in at else w for i, w in enumerate(ws)]
    leaks = {(10 + i, i): ws for i, ws in items.items()} | {(30, 0): swap(items[0], 5, 14, 23, 31), (31, 1): items[1][8:24], (32, 2): swap(items[2], 3, 11)}
    pairs = [(d, " ".join(say(50) + ws + say(50)).upper()) for (d, _), ws in leaks.items()] + [(i, " ".join(say(300))) for i in range(60, 80)] + [(50, None), (51, ""), (52, " ".join(items[0][:8])), (None, " ".join(items[0]))]
    docs, bench = documents(pairs), benchmark(spark, [(i, ", ".join(ws), 1, 1) for i, ws in items.items()] + [(99, None, 1, 1), (98, "", 1, 1), (0, " ".join(items[0]), 1, 1)])
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.overlaps(docs, bench).collect()}
    assert got.keys() == leaks.keys()
    assert got[30, 0]["matched"] == 36 and got[30, 0]["length"] == 40 and got[10, 0]["start"] == 50
    assert {r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()} == {d for d, _ in pairs} - {d for d, _ in leaks}
    shuffled = {(r["doc_id"], r["item_id"]): r for r in decontamination.overlaps(docs, bench, table_bytes=0).collect()}
    assert shuffled == got


def test_both_ways_of_decontamination_give_equal_rows(spark, documents):
    rng = random.Random(3)
    say = lambda n: [f"t{rng.randint(0, 5000)}" for _ in range(n)]
    items = [(i if i % 3 else None, " ".join(say(n)), 1, 1) for i, n in enumerate((1, 2, 3, 4, 4, 5, 6, 9, 13, 15, 20, 3))]
    docs = documents([(i, " ".join([*say(30), r[1], *say(30), r[1]])) for i, r in enumerate(items)] + [(3, " ".join(say(20))), (77, items[0][1]), (78, None), (79, "")])
    small, large = (sorted(map(str, decontamination.overlaps(docs, benchmark(spark, items), **most).collect())) for most in ({}, {"table_bytes": 0}))
    assert small == large and len(small) >= len(items)


def test_every_accepted_pattern_of_substitutions_is_hit():
    """All patterns of overlaps of 13 to 16 tokens in the middle of a longer item and a longer document."""
    items = decontamination.Items([1], [" ".join(f"t{i}" for i in range(40)).encode()])
    item = items.tokens[0]
    tried = 0
    for n in range(13, 17):
        for bits in range(1 << n):
            if bits.bit_count() > n // 5:
                continue
            doc = np.arange(1000, 1060, dtype=np.uint64)
            doc[20 : 20 + n] = item[10 : 10 + n]
            doc[[20 + i for i in range(n) if bits >> i & 1]] = 5
            if decontamination.passage(doc, item, 10):
                tried += 1
                assert (0, 10) in items.hits(doc), (n, bin(bits))
    assert tried > 4


def test_a_short_overlap_with_a_substitution_is_found(spark, documents):
    words = [f"u{i}" for i in range(30)]
    leak = words[5:18]
    leak[6] = "other"
    docs, bench = documents([(1, " ".join(["a", "b", *leak, "c", "d"]))]), benchmark(spark, [(5, " ".join(words), 1, 1)])
    for most in ({}, {"table_bytes": 0}):
        assert [tuple(r) for r in decontamination.overlaps(docs, bench, **most).collect()] == [(1, 5, 2, 13, 12)]


def test_decontamination_finds_every_whole_item(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir).collect()}
    want = {(k, r["item_id"]) for r in table(spark, sf_dir, "benchmark").collect() for k, t in docs.items() if r["text"] in t}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontamination.op1_spaced_seeds(spark, sf_dir).collect()}


def test_decontamination_of_nothing(spark, documents, none):
    assert decontamination.overlaps(none, benchmark(spark, [(1, "a b c", 1, 1)])).collect() == []
    assert decontamination.overlaps(documents([(1, "a b c")]), benchmark(spark, [])).collect() == []


# toxicity


def labelled(spark, documents, n=400):
    rng = random.Random(4)
    pairs, labels = [], []
    for k in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 60))]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["vile", "nasty"]))
        pairs.append((k, " ".join(words)))
        labels.append((k, 0, int(toxic), "x"))
    extra = [(n, None), (n + 1, ""), (None, "vile nasty vile"), (n + 2, "w1 " * 50_000)]
    return documents(pairs + extra), spark.createDataFrame([*labels, (5, 0, None, "x"), (n, 0, 1, "x"), (None, 0, 1, "x")], "doc_id long, quality int, toxic int, text string"), pairs


def test_toxicity_is_learned_and_held_out(spark, documents):
    docs, labels, pairs = labelled(spark, documents)
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert len(got) == len(pairs) + 4
    for k, _ in pairs:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.5) == int(k % 4 == 0)
    assert got[None]["predicted"] == 1 and got[len(pairs)]["score"] == got[len(pairs) + 1]["score"] < 0.5
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_both_class_models_equal_plain_kneser_ney():
    rng = random.Random(8)
    say = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))).encode()
    ordinary, toxic = ([say("a b c d e É the".split() + extra) for _ in range(30)] for extra in (["plain", "word"], ["vile", "vile", "word"]))
    model, plain = toxicity.count(ordinary, toxic), brute.kneser_ney([ordinary, toxic], toxicity.DISCOUNT)
    texts = [*ordinary[:5], *toxic[:5], b"", b"vile, never heard; The a", b"never never"]
    at, before, first = model.places(*toxicity._join(texts))
    whole, _ = model.logs(at, before)
    for i, t in enumerate(texts):
        assert np.allclose(whole[:, first[i] : first[i + 1]].sum(1), plain(t), rtol=1e-5), t
    # all probabilities after any word, seen or not, sum to one
    n = len(model.words)
    for v in range(n + 2):
        assert np.allclose(np.exp(model.logs(np.arange(n + 1), np.full(n + 1, v))[0]).sum(1), 1, atol=1e-5)


def test_toxicity_of_rare_expressions_needs_no_gate():
    """Expressions of six toxic texts each move a score, as far as the shared backoff lets them."""
    rng = random.Random(9)
    say = lambda: [f"w{rng.randint(0, 400)}" for _ in range(40)]
    rude = [f"rude{i}" for i in range(30)]
    ordinary, toxic = [say() for _ in range(150)], [say() + rng.sample(rude, 3) for _ in range(150)]
    model = toxicity.train([" ".join(t).encode() for t in toxic], [" ".join(t).encode() for t in ordinary], 0.5)
    texts = [" ".join(say() + rng.sample(rude, 3) * (i % 2)).encode() for i in range(200)]
    right = (model.score(*toxicity._join(texts)) >= 0.5) == (np.arange(200) % 2 == 1)
    assert right.mean() > 0.95


def test_toxicity_sample_is_bounded_in_bytes(spark, documents, monkeypatch):
    docs, labels, pairs = labelled(spark, documents, 200)
    taken = {}
    monkeypatch.setattr(toxicity, "train", lambda toxic, ordinary, share: taken.update(toxic=toxic, ordinary=ordinary))
    toxicity.learn(docs.union(docs), labels)
    assert len(taken["toxic"]) == len({k for k, _ in pairs if k % 4 == 0 and zlib.crc32(str(k).encode()) % 5})  # one row of each doc_id
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    toxicity.learn(docs, labels)
    assert sum(map(len, taken["ordinary"][:-1])) < 1000 <= sum(map(len, taken["ordinary"]))


def test_toxicity_without_labels(spark, documents, none):
    docs, labels, pairs = labelled(spark, documents, 20)
    nothing = labels.where("toxic > 5")
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, nothing)).collect()} == {0.0}
    assert toxicity.keep_ordinary(docs, nothing).count() == docs.count()
    assert toxicity.score(none, toxicity.learn(none, labels)).collect() == []


# language


def test_languages_of_held_out_documents(spark, sf_dir):
    want = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir).collect()}
    got = {r["doc_id"]: r for r in language.op4_ftrl_language_id(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in got.items())
    held = [k for k, r in got.items() if r["held_out"]]
    assert sum(got[k]["lang_pred"] == want[k] for k in held) >= 0.95 * len(held)


def test_language_of_odd_texts(documents, odd, none):
    docs = documents([*odd, (20, "123 $$ ..."), (21, "\u0301\u0301"), (None, "the thing")])
    model = language.train([(b"the thing is here and there", "en"), (b"das ding ist hier und dort", "de")] * 20)
    got = defaultdict(list)
    for r in language.identify(docs.selectExpr("doc_id", "text", "doc_id > 5 as held_out"), model).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert got[0] == got[1] == got[2] == got[20] == got[21] == [("und", 0.0)] and got[None][0][0] == "en" and len(got[4]) == 2
    assert language.identify(none.selectExpr("doc_id", "text", "true as held_out"), model).collect() == []
    assert language.train([]).predict(b"abc") == ("und", 0.0)


def test_logits_of_parts_are_those_of_the_whole(monkeypatch):
    model = language.train([(b"the thing is here and there", "en"), (b"das ding ist hier und dort", "de")] * 20)
    s = language.symbols(b"the thing is hier und there " * 40)
    whole = model.logits(s)
    monkeypatch.setattr(language, "PART", 7)
    assert np.allclose(model.logits(s), whole)


# packing


def check_packing(rows, docs):
    ids = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for k, t in docs:
        want[k, (*ids.encode(t or "", add_special_tokens=False).ids, 2)] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for held in sequences.values():
        held.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in held)
        assert [r["offset"] for r in held] == [0, *np.cumsum([r["length"] for r in held])[:-1]] and total <= packing.WINDOW
        assert total & (total - 1) == 0 and all(r["length"] > 0 for r in held)
    placed = Counter()
    for (k, all_ids), n in want.items():
        raw = np.array(all_ids, np.uint32)
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == k)
        if n == 1:
            assert mine[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False)) and mine[-1][0] + mine[-1][1] == len(raw)
        for start, length, crc, whole in mine:
            assert crc == zlib.crc32(raw[start : start + length].tobytes()) and whole == len(raw)
            placed[k] += length
        assert placed[k] == n * len(raw)


def test_packing(spark, sf_dir, documents, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir).collect()]
    check_packing(packing.op6_multi_length_packing(spark, sf_dir).collect(), docs)
    check_packing(packing.pack(documents(odd), packing.tokenizer_path()).collect(), odd)
    assert packing.pack(none, packing.tokenizer_path()).collect() == []


def test_step_groups_carry_near_equal_ids(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "STEP", 2)
    docs = table(spark, sf_dir).coalesce(1)
    rows = packing._pack(packing.tokenizer_path())(iter(docs.select("doc_id", "text").toArrow().to_batches()))
    found = [r for batch in rows for r in batch.to_pylist()]
    ids, tiers = Counter(), {}
    for r in found:
        ids[r["step_group"]] += r["length"]
        assert tiers.setdefault(r["step_group"], r["tier"]) == r["tier"]
    full = 2 * packing.WINDOW
    for tier in set(tiers.values()):
        sizes = [ids[g] for g, t in tiers.items() if t == tier]
        assert all(full <= n <= 1.5 * full for n in sizes if len(sizes) > 1 and n != min(sizes)) and (len(sizes) == 1 or min(sizes) >= full / 2)
    assert len(ids) > 3


def test_word_ids_are_the_tokenizers():
    rng = random.Random(1)
    signs = "abzABZéÉßİΣςσ’'s't.,$%&*#()-_…—²½9 0\n\t\x0b\x85 \x01́ñÑ<|endoftext|>漢字🙂"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    got = packing.WordIds(packing.tokenizer_path(), most=200).texts([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# fingerprints


def test_neighbours(documents, odd, none):
    docs = [(k, t) for k, t in odd if (k, t) not in odd[: odd.index((k, t))]]
    for buckets in (1, 2, 5):
        got = {r["doc_id"]: r for r in fingerprints.neighbours(documents(docs), buckets).collect()}
        order = sorted(docs, key=lambda d: -d[0])
        for (k, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
            t, u = t or "", u or ""
            half = len(t) // 2
            changed = (t[: len(t) - half] + u[:half]).encode()
            r = got[k]
            assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(changed).hexdigest(), fingerprints.fingerprint(t.encode()), fingerprints.fingerprint(changed))
            assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(u.encode())) and 0 <= r["near_edited"] <= 1
    assert fingerprints.neighbours(none, 4).collect() == []
    assert fingerprints.neighbours(documents([(5, "alone")]), 4).count() == 1
    assert fingerprints.neighbours(documents([*odd, (None, "x"), (None, None)]), 3).count() == len(odd) + 2


def test_fingerprints_equal_plain_ones():
    rng = random.Random(6)
    whole = lambda hasher: lambda t: int(hasher.of(hasher.prefix(np.frombuffer(t, np.uint8)), np.array([0]), np.array([len(t)]))[0])
    hashes = whole(fingerprints._CONTEXT_HASH), whole(fingerprints._CHUNK_HASH)
    texts = [bytes(rng.choice(letters) for _ in range(n)) for n in (0, 1, 6, 7, 8, 33, 64, 500, 3000) for letters in (b"a", b"ab", b"abcdefgh ", bytes(range(256)))] + [b"abcdefghij" * 90]
    for t in texts:
        assert fingerprints.fingerprint(t) == brute.piecewise(t, fingerprints.LEAST, fingerprints.CONTEXT, hashes)


def test_fingerprints_of_repetitive_texts_are_bounded():
    start = time.monotonic()
    for t in (b"a" * 5_000_000, b"abcdefghij" * 500_000, b"ab" * 100_000 + bytes(random.Random(1).choices(range(256), k=5000))):
        print_ = fingerprints.fingerprint(t)
        assert max(map(len, print_.split(":")[1:])) <= 8 * fingerprints.LEAST + 1 and fingerprints.likeness(print_, fingerprints.fingerprint(t[:-5])) >= 0
    assert time.monotonic() - start < 30


def test_likeness():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefghij ") for _ in range(6000))
    other = bytes(rng.choice(b"abcdefghij ") for _ in range(6000))
    print_ = fingerprints.fingerprint
    assert fingerprints.likeness(print_(text), print_(text)) == 1
    small = fingerprints.likeness(print_(text), print_(text[:3000] + b"!" + text[3000:]))
    assert small > 0.9 > 0.5 > fingerprints.likeness(print_(text), print_(other))
    assert fingerprints.likeness(print_(b""), print_(text)) == 0

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] if x == y else 1 + min(last[j], row[-1]))
        return row[-1]

    for _ in range(50):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 90))) for _ in range(2))
        assert plain(a, b) == len(a) + len(b) - 2 * fingerprints._common(a, b)


# language-model scores


def base_scores(docs, copies=()):
    """``copies`` are doc_ids of rows that occur once more: a repeated row counts in the corpus as often as it is there."""
    tokens = {k: [*WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in t)), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    c = Counter(w for k in [*docs, *copies] if not held[k] for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for k, ws in tokens.items()}


@pytest.mark.parametrize("head", [4, 1 << 17])
def test_base_scores(documents, odd, texts, none, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    got = lm_scoring.score(documents([*odd, (None, "left out")]), packing.tokenizer_path()).collect()
    want = base_scores(texts, [4])
    assert len(got) == len(texts)
    rows = {r["doc_id"]: r for r in got}
    for k, (held, n, known, total, base) in want.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total) and abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    if head > 4:
        assert lm_scoring.score(none, packing.tokenizer_path()).collect() == []


def test_registered_scores(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf_dir).collect()}
    got = {r["doc_id"]: r for r in lm_scoring.op9_attention_scoring(spark, sf_dir).collect()}
    want = base_scores(docs)
    assert got.keys() == want.keys()
    for k, (held, n, known, total, base) in want.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total) and abs(r["base_score"] - base) < 1e-6 * abs(base)


def test_attention_probabilities():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, n).astype(np.uint32) for n in (30, 5, 0, 90)]
    m = attention.train(texts, 60, passes=3, step_blocks=2)
    # all continuations of a text, and its end, sum to one
    start = texts[0][:20]
    x, where, _ = m.stream([start])
    logs = []
    for slot in range(attention.SLOTS):
        target = np.full(len(x), slot, np.int32)
        logs.append(m._chunk(x, target, 0, len(x))[where[-1]])
    assert abs(np.exp(np.array(logs, np.float64)).sum() - 1) < 1e-3
    assert abs(np.exp(m.within[m.slot == attention.RARE]).sum() - 1) < 1e-6
    # scores don't depend on what else is scored, nor on where windows are cut
    alone = np.array([m.score([t])[0] for t in texts])
    assert np.allclose(m.score(texts), alone, atol=1e-3) and np.allclose(m.score(texts[::-1]), alone[::-1], atol=1e-3)
    # a position sees what is before it only
    y = start.copy()
    y[-1] = (y[-1] + 1) % 40
    a, b = (m._chunk(*(lambda s: (s, np.append(s[1:], attention.END).astype(np.int32), 0, len(s)))(m.stream([t])[0])) for t in (start, y))
    assert np.allclose(a[:-2], b[:-2], atol=1e-5)


def test_attention_learns_from_documents_outside_the_sample(documents, monkeypatch):
    """With no sample at all, what a model knows comes from the tasks' own documents."""
    rng = random.Random(2)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    some, rest = ["apple", "house", "river"], ["window", "garden", "street"]
    pairs = [(i, say(some, 40)) for i in range(250)]
    more = [(1000 + i, " ".join(rest * 30)) for i in range(250)] + [(5001, " ".join(rest * 10)), (5002, " ".join(sorted(rest) * 10))]

    def scores(rows, sample):
        monkeypatch.setattr(lm_scoring, "SAMPLE", sample)
        return {r["doc_id"]: r["score"] for r in lm_scoring.score(documents(rows), packing.tokenizer_path()).collect()}

    alone = scores(pairs + more[-2:], 3)
    both = scores(pairs + more, 0)
    assert both[5001] > alone[5001] + 5


def test_id_counts_are_those_of_the_whole_corpus(spark, documents):
    docs = documents([(i, f"alpha beta w{i}, Gamma!" * (i % 4)) for i in range(300)])
    words = packing.WordIds(packing.tokenizer_path())
    n = words.tokenizer.get_vocab_size()
    got = lm_scoring.counts(docs).mapInArrow(lm_scoring._id_counts(packing.tokenizer_path(), n), "id long, n long").groupBy("id").sum("n").collect()
    want = Counter(np.concatenate(words.texts([r["text"].lower().encode() for r in docs.collect()])).tolist())
    assert {r[0]: r[1] for r in got} == want


def test_attention_sees_sixteen_ids():
    m = attention.train([np.arange(40, dtype=np.uint32)], 60, passes=1)
    text = np.arange(17, dtype=np.uint32)
    other = text.copy()
    other[0] = 30
    target = np.full(attention.CONTEXT + 1 + 17, 3, np.int32)
    a, b = (m._chunk(m.stream([t])[0], target, 0, len(target))[-1] for t in (text, other))
    assert attention.CONTEXT == 16 and a != b


def test_slots_score_as_their_ids():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 3000, n).astype(np.uint32) for n in (40, 0, 4000)]  # more ids than slots
    m = attention.initial(np.bincount(np.concatenate(texts).astype(np.int64), minlength=3000) + 1, 3)
    slots, shares = zip(*map(m.slots, texts), strict=True)
    assert shares[2] < 0 and np.allclose(m.score(list(slots)) + shares, m.score(texts), rtol=1e-6)
    a, b = attention.Learner(m), attention.Learner(m)
    a.add(texts)
    b.add(list(slots))
    assert all((a.p[k] == b.p[k]).all() for k in a.p) and a.n == 4043


def test_training_gradients():
    rng = np.random.default_rng(5)
    m = attention.train([rng.integers(0, 30, 60).astype(np.uint32)], 40, passes=1)
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    windows = rng.integers(0, 30, (3, attention.BLOCK + attention.CONTEXT))
    target, use = rng.integers(0, 30, (3, attention.BLOCK)), rng.random((3, attention.BLOCK)) < 0.8

    def loss(q):
        e = q["emb"][windows]
        own = e[:, attention.CONTEXT :]
        w = (own @ q["q"]) @ (e @ q["k"]).transpose(0, 2, 1) / np.sqrt(attention.WIDTH) + np.where(attention._SEEN, q["bias"][np.clip(attention._DISTANCE, 0, attention.CONTEXT)], -1e9)
        w = np.exp(w - w.max(2, keepdims=True))
        w /= w.sum(2, keepdims=True)
        h = own + w @ (e @ q["v"]) @ q["o"]
        log = lambda z: z - np.log(np.exp(z).sum(-1, keepdims=True))
        c, i = target // attention.SIDE, target % attention.SIDE
        a = np.take_along_axis(log(h @ q["wc"] + q["bc"]), c[..., None], 2)
        b = np.take_along_axis(log(np.einsum("bnd,bndk->bnk", h, q["wi"][c]) + q["bi"][c]), i[..., None], 2)
        return -(a + b)[use].mean()

    g = attention._gradients(p, windows, target, use)
    for name, at in (("emb", (7, 3)), ("q", (2, 5)), ("k", (4, 1)), ("v", (0, 9)), ("o", (6, 6)), ("bias", (2,)), ("wc", (3, 0)), ("bc", (0,)), ("wi", (0, 4, 7)), ("bi", (0, 5))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[name][at]) < 1e-5 + 1e-3 * abs(g[name][at]), name


def test_steps_take_windows_of_four_contexts_with_the_positions_of_before():
    """Fewer rows are gathered and summed: 1.25 for each position, not 2; a learning step has 8192 positions as before."""
    learner = attention.Learner(attention.initial(np.ones(3000, np.int64), 1))
    assert attention.BLOCK + attention.CONTEXT <= 1.25 * attention.BLOCK and learner.step_blocks * attention.BLOCK == 8192
    windows, _, _ = attention._examples(learner.model, [np.arange(2000, dtype=np.uint32)])
    assert (attention._parts(windows[:, :, None])[1, 2, :, 0] == windows[1, 32:64]).all()
    x, at = np.arange(24, dtype=np.float32).reshape(6, 4), np.array([2, 0, 2, 2, 4, 0], np.int32)
    assert (attention._grow(x, at, 5) == [x[1] + x[5], 0 * x[0], x[0] + x[2] + x[3], 0 * x[0], x[4]]).all()


def test_words_have_the_tokenizers_ids_without_its_other_steps(monkeypatch):
    rng = random.Random(3)
    letters = "abcxyzéßñäö÷×ÿàşéñ’'\"!#$%&()*+,-./:;<=>?@[]^_`{|}~0189한中\x01\x7f\u0301"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))).lower().encode() for _ in range(5000)]
    words = list(dict.fromkeys([*words, "straße,".encode(), b"it's", b"plain", b"plain.", b"<|endoftext|>", b"\xff\xfe", b"a\xc3"]))
    path = packing.tokenizer_path()
    want = packing.WordIds(path).split([[w] for w in words])
    for most in (1 << 17, 1):  # memos that are kept, and that start anew
        monkeypatch.setattr(lm_scoring, "MEMO_IDS", most)
        ids, length = lm_scoring.LetterIds(path).each(words)
        assert length.tolist() == [len(x) for x in want] and (ids == np.concatenate(want)).all()


def test_words_and_tails_that_start_anew_change_nothing(odd, monkeypatch):
    import pyarrow as pa

    pairs = [*odd, *((100 + i, f"alpha w{i % 7} beta{i} w{i % 3}, alpha") for i in range(60))]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t or ""], "h": [i], "held_out": [False]}) for i, (k, t) in enumerate(pairs)]
    sent = lambda x: SimpleNamespace(value=x)
    path = packing.tokenizer_path()
    m = attention.initial(np.arange(49408) % 977, 3)

    def scanned():
        monkeypatch.setattr(lm_scoring, "_SHARED", {})
        main, tail = [], Counter()
        for r in pa.Table.from_batches(list(lm_scoring._scan(sent({b"alpha": 9, b"the": 4}), sent((m.slot, m.within, m.p)), path, 100, 50, 7)(iter(batches)))).to_pylist():
            if r["word"] is None:
                main.append({k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()})
                continue
            for key, n in zip(np.frombuffer(r["docs"], np.int64).reshape(-1, 2).tolist(), np.frombuffer(r["n"], np.int32).tolist(), strict=True):
                tail[r["word"], *key] += n
        return main, tail

    main, tail = scanned()
    for i, (r, (k, t)) in enumerate(zip(main, pairs, strict=True)):
        words = (t or "").lower().encode() if (t or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
        (ids,) = packing.WordIds(path).texts([words])
        assert r["doc_id"] == k and r["n_tokens"] == len(words.split()) + 1 and r["slots"] == m.slots(ids)[0].tobytes() and abs(r["shares"] - m.slots(ids)[1]) < 1e-3
        assert {w: n for (w, _, h), n in tail.items() if h == i} == {w: n for w, n in Counter(words.split()).items() if w not in (b"alpha", b"the")}
    monkeypatch.setattr(lm_scoring, "MEMO_WORDS", 1)
    monkeypatch.setattr(lm_scoring, "PAIRS", 1)
    assert scanned() == (main, tail)


# shards


def test_sharding_equals_sql(spark, sf_dir):
    assert spark_rows(sharding.op10_extendible_sharding(spark, sf_dir)) == duck(sf_dir, sharding.ORACLE_SQL)


@pytest.mark.parametrize("limit", [1, 50, 400, 10**6])
def test_shards_fit(documents, odd, limit):
    rows = [*odd, *[(4, "twenty bytes of text")] * 60, (None, "x"), (None, None)]
    got = sharding.assign(documents(rows), limit).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((k, len((t or "").encode())) for k, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["depth"], r["prefix"], r["page"]].append(r)
    for held in shards.values():
        total = sum(r["n_bytes"] for r in held)
        assert total <= limit or len(held) == 1 and held[0]["oversize"]
    # a bucket is split only where it must be: its parent is over the limit
    for depth, prefix, _ in shards:
        if depth:
            assert sum(r["n_bytes"] for r in got if r["depth"] >= depth and r["prefix"] >> (r["depth"] - depth + 1) == prefix >> 1) > limit


def test_sharding_of_nothing(none):
    assert sharding.assign(none, 10).collect() == []


def test_all_ten_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
