import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, score string, line string, fp string, key string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""

    def docs(rows):
        return spark.createDataFrame([(i, t, "en", "s", None, "h", "z", "x", "l", "f", "k") for i, t in rows], DOCS)

    return docs
