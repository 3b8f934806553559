import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with the other columns filled or null."""

    def make(pairs, schema=SCHEMA):
        return spark.createDataFrame([(d, t, None if d is None else "en", None if d is None else f"src{d % 3}", len(t or "")) for d, t in pairs], schema)

    return make


@pytest.fixture
def prose():
    """Random texts of words with a few frequent ones."""

    def text(n, seed, size=4000):
        rng = random.Random(seed)
        return " ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"w{rng.randrange(size)}" for _ in range(n))

    return text


def edit(text, places, seed):
    rng = random.Random(seed)
    w = text.split()
    for i in rng.sample(range(len(w)), places):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)
