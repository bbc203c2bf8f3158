import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe qi ro su ta ve wi xo zu".split() for b in "ba ce di fo gu ha je ki lo mu na pe qi ro su ta ve wi xo zu".split()]


@pytest.fixture(scope="session")
def tables():
    path = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with all that operators must bear: nulls, empty ones, copies, near copies, shared passages, a long one."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(30)]
    passage = prose(rng, 70)
    found = [None, "", " \t\n ", "one", "one two three four", "one two three four", *base, base[3], base[3].upper(), *(f"{b} {passage} {prose(rng, 40)}" for b in base[:6])]
    for i in range(12):  # near copies that drift
        w = base[8 + i % 3].split()
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        found.append(" ".join(w))
    found += [prose(rng, 6000), "x" * 5000, "Ünïcödé wörds " * 40, "no\x00null\u00a0break " * 30, base[5] + "\n" + base[5]]
    return found


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (9, texts[9]), (9, texts[9])]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()
