import pytest

from tests.conftest import DATA, spark  # noqa: F401


@pytest.fixture(scope="session")
def odd_docs(spark):  # noqa: F811
    """Nulls in every column, empty and long texts, ties, repeated rows, columns that clash with internal names."""
    long = " ".join(f"word{i % 977} token{i % 31}" for i in range(20_000))
    rows = [
        (1, "The same old text is told to all of us by the people here again", "en", "a", 10), (1, "The same old text is told to all of us by the people here again", "en", "a", 10),
        (2, None, None, None, None), (None, "a text without an id that the people of the town told", "de", "b", 3), (None, None, None, "b", 0), (3, "", "fr", "c", 0),
        (4, " \n\t ", "fr", "c", 4), (5, long, "en", "a", 9), (6, "x", "es", None, 1), (7, "\n".join(["line of many"] * 30), "en", "a", 5), (8, long, "en", "b", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    extra = ("row", "size", "node", "l_removed", "m_key", "block", "kept", "key", "taken", "hits", "n", "a", "root")
    return df.withColumns({c: F.lit(7) for c in extra})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}
