import pytest

#: A null text, empty ones, repeated rows, a null id, a long text.
EDGE = [(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, "one two three four five six seven"), (None, "lonely text here"), (5, " \t\n"), (6, "word " * 30_000)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with null lang and source and columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, "x", -1, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, shard int, spans string")

    return make


@pytest.fixture(scope="session")
def edge(docs_of):
    return docs_of(EDGE)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
