import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, short and long ones, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(4)
    base, shared = words(rng, 120), words(rng, 60, 5000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, 5), (4, "one two", "de", "b", 7), (5, "ONE two", "de", "b", 7),
        (6, base, "en", "a", 1), (7, base.upper(), "en", "a", 1), (8, " ".join(near), "en", "a", 1), (9, words(rng, 80) + " " + shared + " " + words(rng, 30), "en", "c", 1),
        (10, words(rng, 33) + "\n" + shared, "en", "c", 1), (11, "ab " * 400, "en", "c", 1), (12, words(rng, 9000, 10**6), "en", "a", 1),
        (13, "é漢字😀 <s> x", "en", "a", 1), (None, base, None, None, None), (14, "same row", "fr", "a", 8), (14, "same row", "fr", "a", 8),
    ]
    rows += [(20 + i, words(rng, rng.randrange(1, 90), 60), rng.choice(["en", "de"]), rng.choice(["a", "b"]), 1) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
