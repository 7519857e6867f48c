import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(texts): a table with ids from 0; documents([(id, text), ...]): with those ids."""

    def make(rows, sources=None):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        sources = sources or ["s"] * len(pairs)
        full = [(i, t, "en", s, len(t) if t is not None else None) for (i, t), s in zip(pairs, sources)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def clash():
    """df with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({n: F.lit(1) for n in ("_key", "_own", "rep", "node", "tag", "size", "keep", "hits", "_id", "position", "order", "key", "host", "score")})
