import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) rows, with extra columns that clash with names inside the operators."""

    def make(rows):
        schema = "doc_id bigint, text string, block int, sid string, n int, score string, place int, hash string"
        return spark.createDataFrame([(i, t, 1, "s", 2, "x", 3, "h") for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def long_text():
    """About 40,000 words that hardly repeat."""
    return " ".join(f"w{i * 7919 % 100_003}" for i in range(40_000))
