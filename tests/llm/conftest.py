import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "me") for b in ("lan", "dor", "vis", "pek", "")]


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n pseudo-random words."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """documents(rows): doc_id, text and columns whose names clash with those of the operators' own."""

    def make(rows):
        rows = [(*r, "x", 1, 2, "y") for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, keep string, version int, n int, at string")

    return make
