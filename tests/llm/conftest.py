import random

import pytest

from signalvault.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


SCHEMA = "doc_id long, text string, source string, ids string, secrets string, toxicity string, row string, n long"


@pytest.fixture
def documents(spark):
    """Documents from texts or (doc_id, text, source) rows, with extra columns whose names operators use themselves."""
    def make(rows):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = row if isinstance(row, tuple) else (i, row, "a")
            full.append((doc_id, text, source, "x", "y", "z", "w", i))
        return spark.createDataFrame(full, SCHEMA).coalesce(1)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and white texts, repeated rows, one word, long texts with and without spaces, odd characters."""
    words = random.Random(5)
    long = " ".join(words.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(words.randrange(50)) for _ in range(30_000))
    return [(0, None, None), (1, "", ""), (2, " \t\n\x0b\x0c\r ", "a"), (3, "one", "a"), (4, "one", "b"), (4, "one", "b"), (5, long, "a"),
            (6, long, None), (7, "x" * 30_000, "b"), (8, "é😀▁ <s> \x00 ﬁ  two  spaces ", "é"), (None, "no id here at all", "a"), (9, "A B C D E", "b")]
