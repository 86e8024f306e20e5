import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture
def clashing(docs):
    """Columns with the names that operators use inside."""
    def make(rows):
        df = docs(rows)
        for c in ("id", "t", "row", "lines", "gone", "fp", "size", "shard", "text_hash", "spans", "n_lines", "keeper"):
            df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
