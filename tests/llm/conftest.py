import pytest

LONG = "word one two three " * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"), (2, "THE quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (3, None, None, None), (4, "", "en", ""), (5, " \n\t ", "de", "b"), (6, LONG, "en", "a"), (7, "der hund und die katze 😀 ñandú É", "de", "b"),
        (7, "der hund und die katze 😀 ñandú É", "de", "b"), (None, "no id here", "en", "c"), (8, "12345 !!! 67890", "fr", "a"), (9, "un", None, "b"),
    ]
    wide = [(*r, 1, "x", 2.0, True, "k") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, score int, fp string, n double, kept boolean, key string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
