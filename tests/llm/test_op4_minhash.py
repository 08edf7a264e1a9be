from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose, vocabulary
from wayline.llm import op4_minhash as op
from tests.llm.test_kernel import plain


def brute(rows):
    """component per doc_id by comparing all pairs."""
    sets = [(i, plain(t, 5)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i == j or (x and y and 100 * len(x & y) >= 75 * len(x | y)):
                ri, rj = root(i), root(j)
                parent[max(ri, rj)] = min(ri, rj)
    return {i: root(i) for i in parent}


def check(docs, rows):
    got = op.near_duplicates(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == want[r.doc_id])
    return got


def edited(rng, words, text, n):
    ws = text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(words)
    return " ".join(ws)


@pytest.mark.parametrize("crowd", [op.CROWD, 2])
def test_groups_by_brute_force(spark, docs_of, monkeypatch, crowd):
    monkeypatch.setattr(op, "CROWD", crowd)             # 2: also through the rarest shingles
    rng = random.Random(11)
    words = vocabulary(rng)
    rows, n = [], 0
    for g in range(12):                                  # star-shaped and chained groups around the threshold
        base = prose(rng, words, rng.randint(12, 120))
        for k in range(rng.randint(1, 8)):
            rows.append((n, edited(rng, words, base, rng.choice([0, 1, 1, 2, 3, 5]))))
            base = rows[-1][1] if g % 3 == 0 else base
            n += 1
    passage = prose(rng, words, 60)                      # one passage in many otherwise unlike texts
    rows += [(1000 + i, passage + " " + prose(rng, words, rng.randint(20, 60))) for i in range(25)]
    rng.shuffle(rows)
    check(docs_of(rows), rows)


def test_edges(spark, docs_of):
    text = "one two three four five six seven eight"
    rows = [(5, text), (9, text.upper() + " \n"), (None, text), (7, None), (8, ""), (6, " \t\n"),
            (4, "tiny text"), (3, "Tiny  text"), (2, "text tiny"), (9, "other words stand here all alone now"),
            (1, "other words stand here all alone now"), (5, text)]
    docs = docs_of(rows).withColumn("kept", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("sig", F.lit(0))
    got = check(docs, rows)
    sizes = {r.doc_id: r.n_shingles for r in got if r.doc_id != 9}
    assert sizes == {5: 4, None: 4, 7: 0, 8: 0, 6: 0, 4: 1, 3: 1, 2: 1, 1: 3}
    assert op.near_duplicates(docs.limit(0)).count() == 0
    left = op.deduplicate(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, None, 7, 8, 6, 3, 2}


def test_very_long_texts(spark, docs_of):
    rng = random.Random(3)
    words = vocabulary(rng)
    base = prose(rng, words, 60_000)
    rows = [(1, base), (2, edited(rng, words, base, 500)), (3, edited(rng, words, base, 30_000))]
    got = {r.doc_id: r.component_id for r in op.near_duplicates(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, share in enumerate([0.0, 0.3, 0.75, 1.0]):
        for _ in range(40):
            both = rng.integers(0, 2**63, int(600 * share), dtype=np.uint64)
            sides = []
            for _ in range(2):
                own = rng.integers(0, 2**63, (600 - len(both)) // 2, dtype=np.uint64)
                h = np.concatenate([both, own])
                sides.append(op._pack(op._minima(h, np.array([0, len(h)])))[0].view(np.int64).tolist())
            rows.append((k, *sides))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    got = {r.k: r.e for r in df.groupBy("k").agg(F.avg(op.estimate(F.col("a"), F.col("b"))).alias("e")).collect()}
    for k, want in enumerate([0.0, 0.3, 0.75, 1.0]):
        assert abs(got[k] - want) < 0.02
