import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta", "vi", "we", "zu") for b in ("n", "r", "st", "l", "m", "", "d", "k")]


@pytest.fixture
def prose():
    """Random words, the same for the same seed."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text), with further columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, "en", 1.5, 7, "k") for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, score double, n int, key string")

    return make
