import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    long = "alpha beta gamma delta " * 40_000
    rows = [
        (1, "the cat sat on the mat and looked at me", "en", "a", 1, True, 0.5, "x"),
        (2, "the cat sat on the mat and looked at me", None, None, None, None, None, None),
        (2, "the cat sat on the mat and looked at me", None, None, None, None, None, None),
        (3, None, "fr", "a", 0, False, 0.1, ""),
        (4, "", "en", None, 0, None, None, None),
        (5, " \t\n ", "en", "b", 4, None, None, None),
        (6, long, "en", "b", len(long), None, None, None),
        (None, "no id here", "en", "b", 10, None, None, None),
        (7, "é漢字\U0001f600 <|endoftext|> it's 12 o'clock", "fr", "c", 9, None, None, None),
        (8, "one", None, "c", 3, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
