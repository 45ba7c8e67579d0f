import random

import pytest

LONG = "word " * 60_000 + "x" * 200_000

TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "one two",
    "The quick brown fox jumps over the lazy dog near the old river bank today. " * 3,
    "The quick brown fox jumps over the lazy dog near the old river bank today. " * 3,
    "Le renard brun saute par-dessus le chien paresseux près de la vieille rivière. " * 3,
    "... !!! ###",
    "日本語のテキスト ünïcödé 😀 test",
    LONG,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "src", 7, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[5], rows[5], (None, "no id here at all", "en", "s", 1, "x", "y"), (4, "another text under a used id", "en", "s", 1, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _spans string"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def rng():
    return random.Random(11)
