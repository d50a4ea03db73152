"""Shared fixtures and word makers of these tests."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) pairs."""
    def make(rows, parts=3):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)
    return make


def words(rng, n, vocab=4000):
    return [f"w{rng.integers(vocab)}" for _ in range(n)]
