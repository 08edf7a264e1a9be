from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose, vocabulary
from wayline.llm import op9_mixing as op

TOKENS = {"a": 10_000, "b": 3_000, "c": 500}


def test_exponent_meets_its_target():
    for limit in (1.0, 1.5, 3.0, 50.0):
        w = op.weights(TOKENS, op.find_exponent(TOKENS, None, limit))
        assert op.most_repeated(TOKENS, w, None) <= limit * (1 + 1e-9)
        if limit == 3.0:
            assert op.most_repeated(TOKENS, w, None) == pytest.approx(limit)
    w = op.weights(TOKENS, op.find_exponent(TOKENS, target_entropy=0.9))
    assert op.entropy(w) == pytest.approx(0.9)
    assert op.find_exponent(TOKENS, target_entropy=0.0) == 1.0
    assert op.find_exponent(TOKENS, target_entropy=2.0) == 0.0                 # more than log(3): equal shares
    assert op.weights(TOKENS, 0.0) == {s: pytest.approx(1 / 3) for s in TOKENS}
    for budget in (2000.0, 30_000.0):
        a = op.find_exponent(TOKENS, budget, 2.5)
        assert op.most_repeated(TOKENS, op.weights(TOKENS, a), budget) <= 2.5 * (1 + 1e-9) or a == 1.0


def corpus(docs_of, sizes=(("a", 300), ("b", 80), ("c", 15))):
    rng = random.Random(6)
    words = vocabulary(rng)
    rows, n = [], 0
    for source, count in sizes:
        for _ in range(count):
            rows.append((n, prose(rng, words, rng.randint(5, 60)), "en", source, 0))
            n += 1
    return docs_of(rows), rows


@pytest.mark.parametrize("slice_tokens", [op.SLICE_TOKENS, 64])
def test_quotas_and_passes_by_brute_force(docs_of, monkeypatch, slice_tokens):
    monkeypatch.setattr(op, "SLICE_TOKENS", slice_tokens)
    docs, rows = corpus(docs_of)
    size = {i: len(t.split()) for i, t, *_ in rows}
    total = {}
    for i, _, _, s, _ in rows:
        total[s] = total.get(s, 0) + size[i]
    chosen = op.plan(total, max_repeat=2.5)
    got = op.mix(docs, max_repeat=2.5).collect()
    longest = max(size.values())
    for s, (n, _, quota, whole, rest) in chosen.items():
        mine = [r for r in got if r.source == s]
        assert quota - longest < sum(size[r.doc_id] for r in mine) <= quota
        copies = {}
        for r in mine:
            copies.setdefault(r.doc_id, []).append(r.epoch)
        assert all(sorted(e) in (list(range(whole)), list(range(whole + 1))) for e in copies.values())
        # The last pass takes a prefix of its order.
        last = sorted((r.mix_place, r.doc_id) for r in mine if r.epoch == whole)
        assert sum(size[i] for _, i in last) <= rest
    assert {r.doc_id for r in got} == set(size)                                # nothing is lost without a budget


def test_blocks_hold_the_mixture(docs_of):
    docs, rows = corpus(docs_of, (("a", 900), ("b", 600)))
    got = op.mix(docs, max_repeat=1.2, block_tokens=12_000)
    blocks = got.groupBy("mix_block").agg((F.sum(F.when(F.col("source") == "a", F.col("n_tokens"))) / F.sum("n_tokens"))
                                          .alias("share")).collect()
    whole = got.agg(F.sum(F.when(F.col("source") == "a", F.col("n_tokens"))) / F.sum("n_tokens")).first()[0]
    assert len(blocks) >= 3 and all(abs(b.share - whole) < 0.12 for b in blocks)


def test_budget_below_the_corpus(docs_of):
    docs, rows = corpus(docs_of)
    got = op.mix(docs, budget=2000.0, max_repeat=3.0)
    assert 2000 - 3 * 60 < got.agg(F.sum("n_tokens")).first()[0] <= 2001


def test_edges(docs_of):
    rows = [(1, None, "en", "x", None), (2, "", "en", "x", 0), (3, "one two", "en", None, 7), (3, "one two", "en", None, 7),
            (None, "three", "en", "y", 5), (4, "w " * 100_000, "en", "z", 1)]
    docs = docs_of(rows).withColumn("epoch", F.lit(1)).withColumn("p_src", F.lit(1)).withColumn("_row", F.lit(1))
    got = op.mix(docs, max_repeat=1.0).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 3, 4] and all(r.epoch_ == 0 for r in got)
    assert op.mix(docs.limit(0)).count() == 0
    again = op.mix(docs, max_repeat=3.0)
    assert sorted(map(str, again.collect())) == sorted(map(str, again.collect()))
    assert math.isfinite(again.agg(F.max("mix_place")).first()[0])


def test_too_many_sources(docs_of, monkeypatch):
    monkeypatch.setattr(op, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        op.mix(corpus(docs_of)[0])
