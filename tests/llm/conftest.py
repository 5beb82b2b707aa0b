import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """Documents from texts, with ids by position unless pairs are given."""

    def make(texts, source="s"):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], DOCS)

    return make
