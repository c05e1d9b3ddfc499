import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    texts = [None, "", " \t\n", "a", "one two", "one two three four five six", "One TWO three\x0bfour five six", "x " * 30_000, "é ß 😀 İ ſ <|endoftext|> don't", "password = hunter2hunter2"]
    rows = [(i, t, "en", ["a", None, "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "one two three four five six", None, None, 27), (None, None, None, None, None), (100, "one two three four five six", "en", "b", 27)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "fp", "size", "copies", "score", "predicted", "t", "host", "spans", "rank", "length"):
        df = df.selectExpr("*", f"'z' AS {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
