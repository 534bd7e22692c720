import pytest


@pytest.fixture
def docs(spark):
    """A documents table from texts, or from (doc_id, text) pairs, with columns whose names clash by case."""

    def make(texts, lang=None):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        shape = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, cls int, bucket string, d int, t int"
        return spark.createDataFrame([(i, t, (lang or {}).get(i, "en"), f"s{k % 3}", None if t is None else len(t), "other", 1, "x", 2, 3) for k, (i, t) in enumerate(rows)], shape)

    return make
