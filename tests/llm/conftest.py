from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])


def make_docs(spark, rows, source="s0", lang="en"):
    """documents rows from (doc_id, text) or full tuples."""
    full = [(r + (lang, source, len(r[1]) if r[1] is not None else None)) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows, **kw: make_docs(spark, rows, **kw)


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))
