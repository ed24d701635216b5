import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), "x", 1.0) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS + ", key string, score double")

    return make


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the smallest documents table."""
    import duckdb

    return duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
