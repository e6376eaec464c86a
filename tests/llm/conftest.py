import pytest

DOCS = "doc_id long, text string, node string, words string, score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t in rows], DOCS)

    return make
