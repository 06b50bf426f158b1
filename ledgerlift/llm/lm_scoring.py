"""Language-model scoring: word counts of the whole training corpus, and a causal self-attention model.

Counts of every training document are summed over the corpus (each task first over its own rows). The ``HEAD`` most
frequent words, a fixed number, are sent to all tasks; all other words are joined with the counts in a shuffle, once for
each task and word with all documents that hold it, so no word's rows meet in one place: a word of a third of all rows
is in the head.

The model (``attention``) learns from the training documents; its ids are those of a public tokenizer, applied to the
lower-cased text. Slots, shares and first biases come from the counts of ids in all of them, which are those of its words. Each text is
tokenized once and kept as slots of two bytes an id, which learning and scoring read. Parameters start from
the ``SAMPLE`` documents of least hash of doc_id, as far as ``SAMPLE_BYTES`` reach; then each task learns on from there, over
all training documents it holds, and the tasks' parameters are averaged by their positions. So scores depend on how the
table is split into tasks, in the last digits of a learned model.

Edge cases: null and empty texts are the end token alone; rows with a null doc_id are left out, as their parts can't be
brought together; equal rows (doc_id and text) give one row; without training documents the counts are 0 and
the base score is that of an empty corpus; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .arrays import binary, lower, raw, rows, slices
from .packing import WordIds, tokenizer_path
from .tables import sample, table, written

#: Words of the head, and a word's bytes there at most: longer ones are joined with the tail.
HEAD, HEAD_WORD = 1 << 17, 64
#: Documents that the parameters start from, and about how many bytes of them.
SAMPLE, SAMPLE_BYTES = 600, 16 << 20
#: Distinct words that a task counts before it sends them on, that a process numbers, and whose ids its tokenizer remembers.
MEMO, MEMO_WORDS, MEMO_IDS = 1 << 18, 3 << 17, 1 << 17
#: Pairs of a tail word and a document that a task holds before it sends them on.
PAIRS = 1 << 19
#: Bytes of slots that are worked on at once.
SLOT_BYTES = 3 << 17
_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_IDS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
_LEARNED = pa.schema([("n", pa.int64()), ("p", pa.binary())])
_TAIL = pa.schema([("word", pa.binary()), ("docs", pa.binary()), ("n", pa.binary())])
_PARTS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("known", pa.int64()), ("logs", pa.float64())])
_MAIN = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("slots", pa.binary()), ("shares", pa.float64())])
_BOTH = pa.schema([*_TAIL, *_MAIN])
_BOTH_SCHEMA = "word binary, docs binary, n binary, doc_id long, h long, held_out boolean, n_tokens long, known long, logs double, slots binary, shares double"
_SCORED = pa.schema([*list(_MAIN)[:6], ("score", pa.float64())])


def _words(s) -> list[list[bytes]]:
    data = lower(s.data).tobytes()
    offs = s.offs.tolist()
    return [data[a:b].split() for a, b in zip(offs[:-1], offs[1:], strict=True)]  # of bytes: at 09-0D and 20


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def _count(batches):
    seen: Counter = Counter()
    for s in slices(batches):
        for words in _words(s):
            seen.update(words)
        if len(seen) > MEMO:
            yield rows(_COUNTS, list(seen), list(seen.values()))
            seen = Counter()
    yield rows(_COUNTS, list(seen), list(seen.values()))


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of docs."""
    return docs.select("doc_id", "text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class LetterIds(WordIds):
    """A word of small Latin letters is one piece whatever the tokenizer does before its model, and so are signs behind it but for the apostrophe: the model alone gives the letters' ids."""

    PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        super().__init__(path, MEMO_IDS)
        self.model, self.signs = self.tokenizer.model, {b"": []}
        # the model's letters are bytes: those that print are themselves, the rest follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip([*shown, *sorted({*range(256)} - {*shown})], [*shown, *range(256, 512 - len(shown))], strict=True))

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct lower-case words, end to end, and how many each has."""
        plain = list(map(self.PLAIN.fullmatch, words))
        rest = iter(self.split([[w] for w, m in zip(words, plain, strict=True) if m is None]))
        new = list({m[2] for m in plain if m} - self.signs.keys())
        if len(self.signs) + len(new) > self.most:
            self.signs, new = {b"": []}, list({m[2] for m in plain if m} - {b""})
        self.signs.update((w, x.tolist()) for w, x in zip(new, self.split([[w] for w in new]), strict=True))
        out, length, signs, tokenize = array("I"), [], self.signs, self.model.tokenize
        for m in plain:
            if m:
                stem, tail = m.groups()
                text = stem.decode() if stem.isascii() else stem.decode("latin-1").translate(self.letters)
                ids = [t.id for t in tokenize(text)] + signs[tail]
            else:
                ids = next(rest).tolist()
            out.extend(ids)
            length.append(len(ids))
        return np.array(out, np.uint32), np.array(length, np.int64)


def _put(into: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``new`` behind the first n values of an array, which doubles when it is full: arrays that grow by a little each time leave holes."""
    if n + len(new) > len(into):
        into = np.concatenate([into[:n], np.empty(max(n, len(new), 1 << 16), into.dtype)])
    into[n : n + len(new)] = new
    return into


class _Numbers(dict):
    """Words' numbers, given as they are asked for."""

    def __init__(self):
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Words:
    """Words by number with their tokenizer ids, in one array; tasks of a process use them in turn."""

    def __init__(self, path: str):
        self.tokenizer = LetterIds(path)
        self.start()

    def start(self) -> None:
        self.number, self.n, self.edges, self.ids = _Numbers(), 0, np.zeros(1, np.int64), np.empty(0, np.uint32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found, n = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), self.n
        if len(self.number.words) > n:
            ids, length = self.tokenizer.each(self.number.words[n:])
            self.ids = _put(self.ids, self.edges[n], ids)
            self.edges, self.n = _put(self.edges, n + 1, self.edges[n] + np.cumsum(length)), n + len(length)
        return found


_SHARED: dict[str, Words] = {}


def shared_words(path: str) -> Words:
    if path not in _SHARED:
        _SHARED[path] = Words(path)
    return _SHARED[path]


class _Known:
    """What a task knows of each numbered word: its base logarithm if it is of the head (``counts``), its slots and their summed log shares."""

    def __init__(self, words: Words, model: attention.Attention, counts: dict[bytes, int], log):
        self.words, self.model, self.counts, self.log = words, model, counts, log
        self.start()

    def start(self) -> None:
        self.n, self.logs, self.head, self.shares, self.slots = 0, np.empty(0), np.empty(0, bool), np.empty(0), np.empty(0, np.uint16)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found, n = self.words.numbers(words), self.n
        if self.words.n > n:
            new, edges = self.words.number.words[n:], self.words.edges[n : self.words.n + 1]
            ids = self.words.ids[edges[0] : edges[-1]]
            counts = np.array([self.counts.get(w, 0) for w in new])
            before = np.concatenate([[0.0], np.cumsum(self.model.within[ids])])[edges - edges[0]]
            self.head = _put(self.head, n, counts > 0)
            self.logs = _put(self.logs, n, np.where(counts > 0, self.log(counts), 0))
            self.shares = _put(self.shares, n, np.diff(before))
            self.slots = _put(self.slots, edges[0], self.model.slot[ids])
            self.n = self.words.n
        return found

    def text(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of a sequence of words, and where each word's begin, and the last one's end."""
        first = self.words.edges[found]
        length = self.words.edges[found + 1] - first
        at = np.concatenate([[0], np.cumsum(length)])
        return self.slots[np.repeat(first - at[:-1], length) + np.arange(at[-1])], at


class _Tail:
    """Words outside the head, by their numbers, and the documents that hold them."""

    def __init__(self):
        self.keys, self.pairs, self.n, self.docs, self.held = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)], 0, 0

    def add(self, keys: np.ndarray, words: np.ndarray, docs: np.ndarray) -> None:
        """Occurrences of words in documents with these keys (doc_id, h)."""
        pair, n = np.unique(words * len(keys) + docs, return_counts=True)
        self.pairs.append(np.stack([pair // len(keys), pair % len(keys) + self.docs], 1))
        self.n.append(n)
        self.keys.append(keys)
        self.docs += len(keys)
        self.held += len(n)

    def take(self, words: list[bytes]) -> tuple[list, pa.Array, pa.Array]:
        """(words, their documents' ids and hashes, their counts there); starts anew."""
        (word, doc), n, keys = np.concatenate(self.pairs).T, np.concatenate(self.n), np.concatenate(self.keys)
        order = np.argsort(word, kind="stable")
        word, doc, n = word[order], doc[order], n[order]
        edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
        found, edges = [words[i] for i in word[edges].tolist()], np.append(edges, len(word))
        self.__init__()
        return found, binary(keys[doc].view(np.uint8).ravel(), 16 * edges), binary(n.astype(np.int32).view(np.uint8), 4 * edges)


def _id_counts(path: str, n_ids: int):
    """Counted words -> counted ids of their tokens, once for each task."""

    def run(batches):
        total, ids = np.zeros(n_ids, np.int64), LetterIds(path)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a in range(0, len(words), 1 << 14):
                got, length = ids.each(words[a : a + (1 << 14)])
                total += np.bincount(got, np.repeat(n[a : a + (1 << 14)], length), n_ids).astype(np.int64)  # exact below 2**53
        at = np.flatnonzero(total)
        yield rows(_IDS, at, total[at])

    return run


def _slots(s) -> list[np.ndarray]:
    data = s.data.view(np.uint16)
    return [data[a:b] for a, b in zip((s.offs[:-1] // 2).tolist(), (s.offs[1:] // 2).tolist(), strict=True)]


def _learn(model):
    """Slots of a task's training documents -> its parameters and the positions that they were learned from."""

    def run(batches):
        _SHARED.clear()  # the pass that numbers words is over
        attention.keep_memory()
        learner = attention.Learner(attention.Attention(*model.value))
        for s in slices(batches, "slots", limit=SLOT_BYTES):
            learner.add(_slots(s))
        yield rows(_LEARNED, [learner.n], [attention.to_bytes(learner.p)])

    return run


def initial(counted: DataFrame, ends: int, path: str) -> attention.Attention:
    """The model before learning, by the counts ``counted`` (word, n) of the words of all training documents."""
    n_ids = WordIds(path).tokenizer.get_vocab_size()
    count = np.zeros(n_ids, np.int64)
    for r in counted.mapInArrow(_id_counts(path, n_ids), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most as many as the tokenizer has
        count[r["id"]] = r["n"]
    return attention.initial(count, ends)


def learned(training: DataFrame, slots: DataFrame, model: attention.Attention, path: str) -> attention.Attention:
    """``model`` after the documents of ``training``, whose ``slots`` (doc_id, slots) are those of ``model``."""
    texts = [lower(np.frombuffer(r["text"].encode(), np.uint8)).tobytes() for r in sample(training, training, SAMPLE, SAMPLE_BYTES)] if SAMPLE else []
    attention.keep_memory()
    model = attention.train(WordIds(path).texts(texts), len(model.slot), model=model)
    shared = training.sparkSession.sparkContext.broadcast((model.slot, model.within, model.p))
    # one row of fixed size for each task, read one at a time
    found = written(slots.mapInArrow(_learn(shared), "n long, p binary"))
    total, mean = 0, np.zeros(sum(v.size for v in model.p.values()))
    for r in found.where("n > 0").toLocalIterator():
        total += r["n"]
        mean += (np.frombuffer(r["p"], np.float32) - mean) * (r["n"] / total)
    return attention.Attention(model.slot, model.within, attention.from_vector(mean, model.p)) if total else model


def _parts(total: int, distinct: int):
    """Joined words -> for each document of the batch, how many of its tokens are known and their summed logarithms."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (docs, at), (n, counts) = (raw(batch.column(i)) for i in (0, 1))
            pairs = docs[at[0] : at[-1]].copy().view(np.int64).reshape(-1, 2)
            n = n[counts[0] : counts[-1]].copy().view(np.int32)
            c = np.repeat(batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), np.diff(at) // 16)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs, n, c = pairs[order], n[order], c[order]
            edge = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)]))
            yield rows(_PARTS, pairs[edge, 0], pairs[edge, 1], np.add.reduceat(n * (c > 0), edge), np.add.reduceat(n * base_log(c, total, distinct), edge))

    return run


def base_log(c, total: int, distinct: int):
    return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))


def _scan(head, model, path: str, total: int, distinct: int, ends: int):
    """One pass: a row for each document, with its slots and what its head words give, and rows for the words of the tail."""

    def run(batches):
        end = float(base_log(ends, total, distinct))
        words, tail = shared_words(path), _Tail()
        known = _Known(words, attention.Attention(*model.value), head.value, lambda c: base_log(c, total, distinct))

        def tails():
            found, docs, n = tail.take(words.number.words)
            return rows(_BOTH, found, docs, n, *(pa.nulls(len(found), f.type) for f in _MAIN))

        for s in slices(batches):
            texts = _words(s)
            if len(words.number) > MEMO_WORDS:
                yield tails()
                words.start()
                known.start()
            length = np.array([len(w) for w in texts])
            found, doc, first = known.numbers(list(chain.from_iterable(texts))), np.repeat(np.arange(len(s)), length), np.concatenate([[0], np.cumsum(length)])
            sums = lambda x: np.bincount(doc, x[found], len(s))
            slots, at = known.text(found)
            rest = np.flatnonzero(~known.head[found])
            if len(rest):
                tail.add(np.stack([s.ids.to_numpy(), s.batch.column(2).to_numpy()], 1), found[rest], doc[rest])
            yield rows(_BOTH, *(pa.nulls(len(s), f.type) for f in _TAIL), s.ids, s.batch.column(2), s.batch.column(3), length + 1, sums(known.head).astype(np.int64) + (ends > 0), sums(known.logs) + end, binary(slots.view(np.uint8), 2 * at[first]), sums(known.shares))
            if tail.held > PAIRS:
                yield tails()
        yield tails()

    return run


def _scored(model):
    """Documents' slots -> their scores."""

    def run(batches):
        _SHARED.clear()
        attention.keep_memory()
        m = attention.Attention(*model.value)
        for s in slices(batches, "slots", limit=SLOT_BYTES):
            shares = s.batch.column(7).to_numpy()
            yield rows(_SCORED, *(s.batch.column(i) for i in range(6)), (m.score(_slots(s)) + shares) / np.log(10))

    return run


def score(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), held_out().alias("held_out"))
    training = docs.where("not held_out")
    ends = training.count()
    table_ = written(counts(training))
    distinct, total = table_.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, total = distinct + (ends > 0), total + ends
    head = {bytes(r["word"]): r["n"] for r in table_.where(F.octet_length("word") <= HEAD_WORD).orderBy(F.desc("n"), "word").limit(HEAD).toLocalIterator()}
    model = initial(table_, ends, path)
    sent, shared = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast((model.slot, model.within, model.p))
    # texts are made into slots once, for learning and for scoring
    both = written(docs.mapInArrow(_scan(sent, shared, path, total, distinct, ends), _BOTH_SCHEMA))
    main, tail = both.where("word is null").drop(*_TAIL.names), both.where("word is not null")
    model = learned(training, main.where("not held_out").select("doc_id", "slots"), model, path)
    main = main.mapInArrow(_scored(spark.sparkContext.broadcast((model.slot, model.within, model.p))), "doc_id long, h long, held_out boolean, n_tokens long, known long, logs double, score double")
    joined = tail.join(table_.withColumnRenamed("n", "c"), "word", "left").select("docs", "n", "c")
    parts = joined.mapInArrow(_parts(total, distinct), "doc_id long, h long, known long, logs double")
    one = lambda name: F.col(name).alias(name)
    rows_ = main.select("doc_id", "h", "held_out", "n_tokens", one("known"), one("logs"), "score", F.lit(1).alias("copies"))
    more = parts.select("doc_id", "h", F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"), "known", "logs", F.lit(None).cast("double").alias("score"), F.lit(0).alias("copies"))
    total_of = lambda name: F.sum(name) / F.sum("copies")  # noqa: E731  equal rows give all parts as often as they occur
    return rows_.unionByName(more).groupBy("doc_id", "h").agg(F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), total_of("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), total_of("logs").alias("base_score"), F.max("score").alias("score")).drop("h")


def op9_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), tokenizer_path())
