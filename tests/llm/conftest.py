"""Documents with everything that may be odd about them."""

import pytest

LONG = " ".join(f"word{k % 977} tail{k % 31}" for k in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away.", "en", "a", 62, 0.5, 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away.", "en", "a", 62, 0.5, 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away.", "en", "a", 62, 0.5, 1),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, 0.1, 2),
    (5, " \t\n ", "en", "a", 4, 0.1, 2),
    (None, "A text whose row has no id at all, äöü and 日本語 ▁ inside.", "de", "b", 1, 0.0, 3),
    (6, LONG, "en", "b", len(LONG), 0.9, 4),
    (7, "one two", "en", "b", 7, 0.9, 4),
    (8, "ONE two", "en", "b", 7, 0.9, 4),
    (10, " " * 400_000 + "x" + "\n" * 350_000 + "y", "en", "b", 7, 0.9, 4),
    (9, "Straße <|endoftext|> Ünïcödé   \x00 end", "de", "b", 7, 0.9, 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node int, _text string, _row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats; extra columns with names that the operators use themselves."""
    return spark.createDataFrame([(*r, "kept", str(r[0])) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
