import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, bare string, _id string, _source string, label string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source), with more columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else 0, "x", "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
