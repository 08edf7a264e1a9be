from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from wayline.llm import op1_ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vecs, q, k):
    v = np.asarray(vecs, float)
    i = ids.index(q)
    s = (v * v[i]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[i] * v[i]).sum()))
    return sorted(((-s[j], ids[j]) for j in range(len(ids)) if j != i))[:k]


def test_recall_against_brute_force(spark):
    t = spark.read.parquet(f"{SF01}/embeddings.parquet")
    got = op1_ann.nearest(t, F.col("vec_id") % 50 == 0).collect()
    rows = t.select("vec_id", "embedding").collect()
    ids, vecs = [r.vec_id for r in rows], [r.embedding for r in rows]
    hits = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        want = {i for _, i in brute(ids, vecs, q, 5)}
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        hits += len(want & {r.vec_id for r in mine})
        total += 5
    assert hits / total >= 0.9


def test_several_cells_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vecs = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    monkeypatch.setattr(op1_ann, "CELL_ROWS", 100)
    monkeypatch.setattr(op1_ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(op1_ann, "QUERY_ROWS", 3)
    t = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vecs)], SCHEMA)
    got = op1_ann.nearest(t, F.col("vec_id") % 50 == 0).collect()
    hits = 0
    for q in range(0, 900, 50):
        want = {i for _, i in brute(list(range(900)), vecs, q, 5)}
        hits += len(want & {r.vec_id for r in got if r.query_id == q})
    assert hits / (18 * 5) >= 0.9


def test_unusable_rows_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [0.0, 1.0], 1),
            (1, None, 1), (2, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1),
            (6, [None, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (50, [], 1)]
    t = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    got = op1_ann.nearest(t, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 3), (0, 2, 7), (0, 3, 9)]
    assert [r.score for r in got] == [1.0, 1.0, 0.0]


def test_hot_vector_keeps_the_smallest_ids(spark):
    rows = [(i, [1.0, 1.0, 0.0], 0) for i in range(0, 400)] + [(1000, [1.0, 0.0, 0.0], 0)]
    got = op1_ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    for q in range(0, 400, 50):
        want = [i for i in range(7) if i != q][:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_empty_table(spark):
    assert op1_ann.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_chi_square():
    assert op1_ann.chi_square_cdf(op1_ann.stop_ratio(0.95)) == pytest.approx(0.95)
    assert op1_ann.stop_ratio(0.95) == pytest.approx(15.5073, abs=1e-3)   # table value for 8 degrees of freedom
