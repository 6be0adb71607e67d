import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with inner ones."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        if extra:
            df = df.selectExpr("*", "'x' AS node", "1 AS score", "'y' AS key", "2 AS depth", "3 AS _id", "4 AS kept", "5 AS _h", "6 AS z")
        return df

    return make
