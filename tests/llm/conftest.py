import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


#: Nulls, empty and wordless texts, one very long text, repeated rows, ties, and a column that clashes with outputs.
@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, None, "en", "a", 9), (2, "", None, None, 9), (3, " \n\t", "en", "a", 9), (4, "x", "en", "a", 9), (5, long, "en", "a", 9), (6, "the cat sat on the mat by the door", "en", None, 9), (6, "the cat sat on the mat by the door", "en", None, 9), (7, "the cat sat on the mat by the door", None, "b", 9), (None, "the cat sat on the mat by the door", "en", "b", 9), (8, "12345 !!", "en", "b", 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
