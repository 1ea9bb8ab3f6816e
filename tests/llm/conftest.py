import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents from (doc_id, text) or (doc_id, text, source), with columns whose
    names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 1, "x", 2) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS + ", size int, digest string, id int")

    return make
