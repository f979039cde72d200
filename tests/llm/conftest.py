import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows; its other columns clash with internal names."""

    def make(rows, types="doc_id long, text string"):
        return spark.createDataFrame(rows, types).selectExpr(
            "*", "'en' lang", "'s' source", "1 n_chars", "'x' component_id", "0 kept", "'y' line", "1 key", "2 bucket")

    return make
