"""Hierarchical multi-length packing.

A document's ids (public tokenizer, then id 2) are cut at ``WINDOW``: whole windows first, the rest is routed to the
smallest tier that holds it. Each tier packs its own pieces best fit into sequences of its size; the longest tier's
gaps, then those of each shorter tier in turn, are filled from the tiers below, cutting a piece where it does not fit. Only the last few
sequences of a task can stay short; they are cut into power-of-two lengths, so that next to nothing is padding.
Step groups hold sequences of one tier and carry equal ids whatever the tier: ``STEP`` sequences of ``WINDOW`` ids, or as many
more as they are shorter. Of a task's last sequences of a tier fewer than half a group are spread evenly over its others.

No shuffle is needed: each input task packs its own rows and numbers its sequences from ``partition << 33``.
What a task holds is bounded: gaps are filled and finished sequences leave after every slice of text.

Edge cases: null text and empty text are the single id 2; repeated rows are packed each; a null ``doc_id`` is packed
and stays null; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .arrays import rows, slices
from .tables import table

WINDOW = 4096
TIERS = (256, 1024, WINDOW)
END_ID = 2
#: Sequences of a tier that may stay open in a task; beyond it they are filled up and leave.
OPEN = 64
#: Sequences of a step group, of the longest tier.
STEP = 64
#: Signs that end a word and are pieces of their own behind a letter or digit; the apostrophe is not, as it can join letters.
_TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in re.findall(r"(\w+) (?:long|int)", SCHEMA)])


class WordIds:
    """Ids of whole texts through a bounded memo of words: the tokenizer drops white space, so words are independent.

    New words are encoded many at a time, joined by a mark that is one id and never part of a longer one.
    """

    MARK = "\x01"

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core only
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (self.mark,) = self._encode(self.MARK)
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.most = most

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each of some words without the mark."""
        out = []
        for a in range(0, len(words), 512):
            part = words[a : a + 512]
            ids = np.array(self._encode(f" {self.MARK} ".join([w.decode("utf-8", "replace") for w in part])), np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)], strict=True)]
        return out

    def _learn(self, new: list[bytes]) -> None:
        """The tokenizer folds case and ends a piece between a letter or digit and other signs: a word is its stem's and its tail's ids."""
        mark, stems, whole = self.MARK.encode(), [], []
        for w in new:
            low = w.lower()
            stem = low.rstrip(_TAIL)
            if mark in w:
                self.memo[w] = np.array(self._encode(w.decode("utf-8", "replace")), np.uint32).tobytes()
            elif stem and len(stem) < len(low) and stem[-1:].isalnum():
                stems.append((w, stem, low[len(stem) :]))
            elif low == w:
                whole.append(w)
            else:
                stems.append((w, low, b""))
        parts = {x for _, stem, tail in stems for x in (stem, tail)}
        parts.update(whole)
        unknown = [x for x in parts if x not in self.memo]
        memo = self.memo
        memo.update(zip(unknown, self._ids(unknown), strict=True))
        memo.update([(w, memo[stem] + memo[tail]) for w, stem, tail in stems])

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.split([t.split() for t in texts])  # of bytes: at 09-0D and 20

    def split(self, split: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.memo) > self.most:
            self.memo = {b"": b""}
        memo = self.memo
        self._learn(list({w for ws in split for w in ws if w not in memo}))
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, ws)), np.uint32) for ws in split]


_SHARED: dict[str, WordIds] = {}


def shared_ids(path: str, most: int = 1 << 20) -> WordIds:
    """The process's memo, which the tasks of one Python worker use in turn."""
    if path not in _SHARED:
        _SHARED[path] = WordIds(path)
    _SHARED[path].most = most
    return _SHARED[path]


def pieces(doc_tokens: int) -> list[tuple[int, int]]:
    """(start, length): whole windows, then the rest."""
    cuts = [(a, WINDOW) for a in range(0, doc_tokens - WINDOW + 1, WINDOW)]
    done = len(cuts) * WINDOW
    return cuts + ([(done, doc_tokens - done)] if doc_tokens > done else [])


class Packer:
    """Packs pieces (key, start, length) of bounded number; ``take()`` gives finished sequences as (tier, [pieces])."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.open: dict[int, list[list]] = {t: [] for t in tiers}  # tier -> [room, [pieces]]
        self.done: list[tuple[int, list]] = []

    def add(self, piece: tuple) -> None:
        n = piece[2]
        tier = next(t for t in self.tiers if n <= t)
        if n == tier:
            self.done.append((tier, [piece]))
            return
        best = min((s for s in self.open[tier] if s[0] >= n), key=lambda s: s[0], default=None)
        if best is None:
            self.open[tier].append(best := [tier, []])
        best[0] -= n
        best[1].append(piece)
        if not best[0]:
            self.open[tier].remove(best)
            self.done.append((tier, best[1]))
        if len(self.open[tier]) > OPEN:
            self.fill(tier, OPEN // 2)

    def fill(self, tier: int, keep: int = 0) -> None:
        """Fill the gaps of the tier's fullest sequences from shorter tiers, then from its own emptiest, until ``keep`` are open."""
        own = self.open[tier]
        own.sort(key=lambda s: s[0])
        while len(own) > keep:
            room, held = own.pop(0)
            while room:
                source = next((t for t in reversed(self.tiers) if t < tier and self.open[t]), None) or (tier if own else None)
                if source is None:
                    break
                giver = max(self.open[source], key=lambda s: s[0])
                key, start, n = giver[1].pop()
                use = min(n, room)
                held.append((key, start, use))
                room -= use
                giver[0] += n
                if use < n:
                    giver[1].append((key, start + use, n - use))
                    giver[0] -= n - use
                if not giver[1]:
                    self.open[source].remove(giver)
            if room:
                own.insert(0, [room, held])
                break
            self.done.append((tier, held))

    def close(self) -> None:
        """Fill everything, longest tier first; what stays is cut into power-of-two sequences."""
        for tier in reversed(self.tiers):
            self.fill(tier)
        rest = [p for t in reversed(self.tiers) for _, held in self.open[t] for p in held]
        self.open = {t: [] for t in self.tiers}
        left = sum(p[2] for p in rest)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            held, room = [], size
            while room:
                key, start, n = rest.pop(0)
                use = min(n, room)
                held.append((key, start, use))
                if use < n:
                    rest.insert(0, (key, start + use, n - use))
                room -= use
            self.done.append((size, held))
            left -= size

    def take(self) -> list[tuple[int, list]]:
        done, self.done = self.done, []
        return done


def _pack(path: str):
    def run(batches):
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        words, packer, number = shared_ids(path), Packer(), 0
        live: dict[int, list] = {}  # key -> [doc_id, ids, ids still unplaced]
        groups: dict[int, int] = {}  # tier -> full ones
        waiting: dict[int, list[list[tuple]]] = {}  # tier -> rows of sequences whose group isn't full
        count = 0

        def finished(last: bool = False):
            nonlocal number
            out: list[tuple] = []

            def deal(tier: int, sequences: list[list[tuple]], first: int, over: int) -> None:
                for i, held in enumerate(sequences):
                    group = (base + first + i % over) * 64 + tier.bit_length()
                    out.extend((*r, group) for r in held)

            for tier, held in packer.take():
                at, found = 0, []
                for key, start, n in held:
                    doc_id, ids, _ = entry = live[key]
                    entry[2] -= n
                    found.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + number, at, sum(p[2] for p in held), tier))
                    at += n
                    if not entry[2]:
                        del live[key]
                number += 1
                waiting.setdefault(tier, []).append(found)
                if len(waiting[tier]) == STEP * WINDOW // tier:
                    deal(tier, waiting.pop(tier), groups.get(tier, 0), 1)
                    groups[tier] = groups.get(tier, 0) + 1
            for tier, sequences in waiting.items() if last else ():
                full = groups.get(tier, 0)
                few = 2 * len(sequences) < STEP * WINDOW // tier and full
                deal(tier, sequences, 0 if few else full, full if few else 1)
            return rows(_ARROW, *(zip(*out, strict=True) if out else [[]] * len(_ARROW)))

        for s in slices(batches):
            for doc_id, ids in zip(s.ids.to_pylist(), words.texts([s.text(i) for i in range(len(s))]), strict=True):
                ids = np.append(ids, np.uint32(END_ID))
                live[count] = [doc_id, ids, len(ids)]
                for start, n in pieces(len(ids)):
                    packer.add((count, start, n))
                count += 1
            yield finished()
        packer.close()
        yield finished(last=True)

    return run


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row for each piece; ``sequence_length`` ids are in its sequence, whose padded size is ``tier`` (a power of two)."""
    return docs.select("doc_id", "text").mapInArrow(_pack(path), SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
