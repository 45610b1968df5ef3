import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts; ids count up from 0."""

    def make(texts, ids=None, sources=None, langs=None):
        rows = [
            (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "a", len(t or ""))
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS)

    return make
