import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang="en", source="s0", first=0):
    """A documents table; texts can be null."""
    rows = [(first + k, t, lang, source, None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)
