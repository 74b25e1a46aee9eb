import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents as (doc_id, text), with columns whose names operators use inside."""

    def make(rows, parts=3):
        full = [(i, t, "en", "src", "k", 1, 2.0, 3) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, key string, d int, "
                  "name double, comp int").repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empty texts, one word, ties, repeated rows and a very long text."""
    rnd = random.Random(11)
    vocabulary = ["a", "b", "ab", "of", "the", "é", "xx", "naïve"]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(5)]
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (None, passages[0]),
            (5, "a " * 400), (6, "a " * 130 + "b"), (7, "a b " * 200), (8, "x" * 300),
            (9, "x" * 120 + "y" + "x" * 120), (9, "another text for one doc_id " * 9)]
    for i in range(10, 50):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else
                 " ".join(f"w{rnd.randint(0, 999)}" for _ in range(rnd.randint(1, 30)))
                 for _ in range(rnd.randint(1, 5))]
        rows.append((i, (" " if rnd.random() < 0.7 else "\n\t").join(parts)))
    rows += rows[12:16]  # repeated rows
    rows.append((60, " ".join(f"v{rnd.randint(0, 50)}" for _ in range(60_000)) + " " + passages[1]))
    return rows
