import random

import pytest

#: Rows that every operator on documents must stand: nulls, empty and long texts, ties, repeats.
ODD = [
    (None, "a row without an id " * 8, "en", None, None),
    (1, None, None, "s", 0),
    (2, "", "en", "s", 0),
    (3, " \t\n\r\x0b\x0c ", "en", "s", 0),
    (4, "one", "en", "s", 0),
    (5, "é́ 中文 \U0001f600 ▁ ﬁ İ K \x1c x\x00y", "xx", "s", 0),
    (6, "word " * 60_000, "en", "s", 0),
    (7, "same text in two rows " * 10, "en", "s", 0),
    (7, "same text in two rows " * 10, "en", "s", 0),
    (8, "same text in two rows " * 10, "en", "s", 0),
    (9, "7 7 7 ... ,, !! ## | |", None, "s", 0),
    (-5, "negative id " * 30, "en", "s", 0),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def prose():
    """Documents of made-up words, deterministic."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return lambda n, seed=0: " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns named like the operators' own, of other types."""
    from pyspark.sql import functions as F

    names = ["row", "words", "node", "score", "kept", "n_words", "component_id", "class", "salt", "x", "features", "tuples"]
    return odd.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SHAPE)
