import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, an empty and a very long text, copies, a repeated row, a null id, and columns with names that operators use."""
    words = random.Random(5)
    long = " ".join(words.choice(["alpha", "beta", "gamma", "delta", "17"]) + str(words.randrange(90)) for _ in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "a b c"), (4, "a b c"), (5, "x"), (5, "x"), (6, long), (7, "  \n\t "), (8, "don't stop 12.7.0.1 a@b.co"), (None, "no id here"), (9, None),
    ]
    docs = [(i, t, None if i == 8 else "en", None if i == 3 else f"src{i}", len(t or ""), 0, "k", 1.5) for i, t in rows]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, keep_id int, kept string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
