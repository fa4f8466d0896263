import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture
def odd(spark):
    """Documents with nulls, empties, ties, repeated rows and a long text."""
    rows = [
        (None, None, None, None, None, "x"), (1, "", "en", "a", 0, None), (2, " \t\n", "en", None, 3, "x"), (3, "one two three", "en", "a", 13, "x"),
        (3, "one two three", "en", "a", 13, "x"), (4, "w " * 40_000, "de", "b", 80_000, "x"), (5, "é\u2028ü 日本 😀 token", None, "", 9, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
