import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, block int, score double, h string, spans string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with more columns than operators ask for, some named like what they add."""

    def build(rows, langs=None):
        langs = langs or [None] * len(rows)
        return spark.createDataFrame([(i, t, g, "s", len(t or ""), 1, 0.5, "x", "y") for (i, t), g in zip(rows, langs, strict=True)], COLUMNS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Pseudo-random texts of an invented vocabulary."""

    def write(n, seed=0, words=400, vocabulary=3000):
        rng = random.Random(seed)
        vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
        return [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, words))) for _ in range(n)]

    return write


@pytest.fixture(scope="session")
def odd():
    """Texts at the edges: null, empty, white space only, control characters, wide characters, a long word, repeats."""
    return [None, "", " \t\n\x0b\x0c\r ", "\x00\x1c\x85a b　c", "naïve 😀😀 Straße​", "x" * 3000, "a b c", "a b c", "A  B\nC", "ſ K"]
