import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g long, fp long, key long, a string, node long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(pairs, lang=None):
        rows = [(k, t, lang[i] if lang else "en", None, None if t is None else len(t), 7, 7, 7, "x", 7) for i, (k, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, ties, repeated rows, separators only, characters of four bytes."""
    import random

    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    near = list(base)
    near[150] = "EDITED"
    return [
        (0, None), (1, ""), (2, " \t\n"), (3, " ".join(base)), (4, " ".join(base)), (4, " ".join(base)), (5, " ".join(near)), (6, "x"), (7, "one two"), (8, say(5000)), (9, "é" * 150 + "🙂" * 60),
        (10, "ab" * 400), (11, "the the " * 60), (12, say(40) + " " + " ".join(base[20:80]) + " " + say(40)), (13, say(30) + "\n" + " ".join(base[20:80]) + "\n" + say(10)), (14, "É" * 150 + "é" * 150), (-3, " ".join(base[:120])),
    ]


@pytest.fixture(scope="session")
def texts(odd):
    return {k: (t or "").encode() for k, t in odd}
