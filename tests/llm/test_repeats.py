"""Both repeat operators against plain versions."""

import random

import brute
import numpy as np
import pytest

from ledgerlift.llm import run_length_index as R
from ledgerlift.llm import suffix_trees as T
from ledgerlift.llm.repeats import apply


def op2(docs):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in apply(docs, R.SPEC, R.SCHEMA, R._ARROW, R._digest).collect()}


def op7(docs):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in apply(docs, T.SPEC, T.SCHEMA, T._ARROW, T._digest).collect()}


def test_odd_texts(documents, odd, texts):
    docs = documents([*odd, (None, "left out")])
    assert op2(docs) == brute.substrings(texts)
    assert op7(docs) == brute.passages(texts)


def test_rows_that_repeat_a_doc_id_all_come_back(documents):
    say = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    pairs = [(1, say("a")), (1, say("b")), (1, say("b")), (1, say("a") + " " + say("c")), (2, "two " + say("c")), (2, None), (3, say("d"))]
    found = R.cut_repeats(documents(pairs)).collect()
    # of texts of one doc_id the lesser comes first: what it holds is cut from the others, and from later documents
    assert sorted((r["doc_id"], r["text"]) for r in found) == [(1, " " + say("c")), (1, say("a")), (1, say("b")), (1, say("b")), (2, ""), (2, "two"), (3, say("d"))]
    words = sorted((r["doc_id"], r["kept"]) for r in T.remove_repeats(documents(pairs)).collect())
    assert words == [(1, say("a")), (1, say("a") + " " + say("c")), (1, say("b")), (1, say("b")), (2, ""), (2, "two"), (3, say("d"))]


def test_empty_table(documents):
    docs = documents([]) if False else documents([(1, "x")]).where("doc_id < 0")
    assert op2(docs) == {} and op7(docs) == {}


def test_many_small_groups(documents, monkeypatch):
    """Repeats across and inside groups, when each document is a group of its own and each mark an index."""
    from ledgerlift.llm import repeats

    monkeypatch.setattr(repeats, "GROUP_BYTES", 700)
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(20, 90))) for _ in range(6)]
    pairs = [(k, " ".join(rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 40) :], "q" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    docs, plain = documents(pairs), {k: t.encode() for k, t in pairs}
    assert op2(docs) == brute.substrings(plain)
    assert op7(docs) == brute.passages(plain)


def test_registered_queries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    plain = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.op2_run_length_index(spark, sf_dir).collect()}
    assert got == brute.substrings(plain)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in T.op7_suffix_trees(spark, sf_dir).collect()}
    assert got == brute.passages(plain)


def test_kept_texts(documents, odd, texts):
    docs = documents([*odd, (None, "stays")])
    got = {r["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in R.remove_repeats(docs).collect()}
    for k, (kept, spans) in got.items():
        gone = set().union(*(range(a, b) for a, b in spans))
        assert kept == bytes(c for i, c in enumerate(texts[k]) if i not in gone)
    cut = R.cut_repeats(docs)
    assert cut.columns == docs.columns
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert rows[None]["text"] == "stays" and rows[4]["text"] == "" and rows[8]["n_chars"] == len(rows[8]["text"])
    assert all(rows[k]["text"] == kept.decode("utf-8", "ignore") for k, (kept, _) in got.items())
    words = {r["doc_id"]: r["kept"] for r in T.remove_repeats(docs).collect()}
    assert words[3] == " ".join(texts[3].decode().split())[len(" ".join(texts[-3].decode().split())) + 1 :]


@pytest.mark.parametrize("alphabet", [1, 2, 5, 200])
def test_suffix_array_and_matching_statistics(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 50, 400):
        s = rng.integers(0, alphabet + 1, n).astype(np.uint8)
        data = s.tobytes()
        sa = sorted(range(n), key=lambda i: data[i:])
        assert R.suffix_array(s).tolist() == sa
        length, above = R.RunLengthIndex(s).matching_statistics()
        for row in range(1, n):
            i, j = sa[row], sa[row - 1]
            same = next((k for k in range(n) if i + k >= n or j + k >= n or data[i + k] != data[j + k]), n)
            assert length[i] == same and (same == 0 or above[i] == j)


def test_prefix_groups_are_bounded_and_whole():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 3, 3000)
    at = np.arange(2900)
    groups = [g for _, g in T.prefix_groups(s, at, limit=40)]
    assert sorted(np.concatenate(groups).tolist()) == at.tolist() and max(map(len, groups)) <= 40
    head, whole = T.classes(s, at, 5, limit=40), {}
    for i in at.tolist():
        assert whole.setdefault(tuple(s[i : i + 5]), head[i]) == head[i]
    assert len(set(head[at].tolist())) == len(whole)
