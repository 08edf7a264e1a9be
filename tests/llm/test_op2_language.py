from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF01
from wayline.llm import op2_language as op
from wayline.llm.queries import QUERIES

TEXTS = {"aa": "banana bandana manana", "bb": "street strength strong"}


def counts(text):
    s = " " * (op.ORDER - 2) + "".join(map(chr, op.fold(text).tolist()))
    out = {}
    for i in range(op.ORDER - 1, len(s)):
        out[s[i - op.ORDER + 1:i + 1]] = out.get(s[i - op.ORDER + 1:i + 1], 0) + 1
    return out


def test_probabilities_sum_to_one_and_scores_follow_the_recursion():
    model = op.KneserNey({k: counts(v) for k, v in TEXTS.items()})
    tables = [model._language(counts(v)) for v in (TEXTS[x] for x in model.langs)]
    for t, lang in zip(tables, model.langs):
        alphabet = {g for g in t[0][1]}
        for ctx in ("", "a", "st", " ba", "zzz", "anb"):
            total = sum(model._prob(t, ctx + c) for c in alphabet) + model._prob(t, ctx + "Ж")
            assert math.isclose(total, 1.0, rel_tol=1e-9)
    for text in ("banana strong Жx", "zz", "St. Banana!"):
        c = op.fold(text)
        s = " " * (op.ORDER - 2) + "".join(map(chr, c.tolist()))
        want = np.array([[math.log2(model._prob(t, s[i - op.ORDER + 1:i + 1])) for t in tables]
                         for i in range(op.ORDER - 1, len(s))])
        assert np.allclose(model.score(c), want)


def test_long_texts_in_parts(monkeypatch):
    model = op.KneserNey({k: counts(v) for k, v in TEXTS.items()})
    c = op.fold("banana strong " * 50)
    whole = model.entropies([c])
    monkeypatch.setattr(op, "CHUNK_CHARS", 17)
    assert np.allclose(model.entropies([c]), whole)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF01).collect()}
    true = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in true if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (r in held) for r in true)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(TEXTS[k].split()) for _ in range(30)), k, "s", 1)
            for i, k in enumerate(["aa", "bb"] * 20)]
    rows += [(100, None, "aa", "s", 1), (101, "", "aa", "s", 1), (102, "12 !? \n", None, "s", 1), (None, "banana", None, "s", 1),
             (103, "x" * 200_000, "bb", "s", 1), (0, rows[0][1], "aa", "s", 1)]
    docs = docs_of(rows).withColumn("score", F.lit(9)).withColumn("bits", F.lit(9))
    out = op.identify(docs, op.train(docs.select("text", "lang"))).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0 and not by[100].rejected
    assert by[None].lang_pred == "aa" and by[0].lang_pred == "aa" and by[1].lang_pred == "bb"
    assert by[103].lang_pred in ("aa", "bb")


def test_copies_do_not_thin_out_a_language(docs_of, monkeypatch):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(TEXTS[k].split()) for _ in range(30))
    few = [text("aa") for _ in range(20)]
    rows = [(i, few[i % 20], "aa", "s", 1) for i in range(8000)] + [(9000 + i, text("bb"), "bb", "s", 1) for i in range(30)]
    used, model = [], op.KneserNey
    monkeypatch.setattr(op, "KneserNey", lambda counts: used.append(counts) or model(counts))
    trained = op.train(docs_of(rows).select("text", "lang"), sample_docs=20)
    assert trained[0].langs == ["aa", "bb"]
    # All 20 different texts are drawn; two of them are held back for calibration.
    total = sum(used[0]["aa"].values())
    lengths = sorted(len(op.fold(t)) - 1 for t in few)
    assert sum(lengths[:18]) <= total <= sum(lengths[-18:])


def test_snippets_lie_anywhere_in_the_text(spark, docs_of):
    texts = [" ".join(f"w{j}" for j in range(1000)) for _ in range(1)] + ["short text"]
    texts += [f"own{i} " + texts[0] for i in range(30)]
    got = [r.s for r in docs_of(list(enumerate(texts))).select(op.snippet(F.col("text"), 20).alias("s")).collect()]
    assert got[1] == "short text" and all(g in t for g, t in zip(got, texts))
    places = [t.index(g) / len(t) for g, t in zip(got[2:], texts[2:])]
    assert min(places) < 0.3 and max(places) > 0.7


def test_without_training_rows(docs_of, spark):
    docs = docs_of([(1, "abc", None, "s", 3)])
    assert op.train(docs.select("text", "lang")) is None
    assert op.identify(docs, None).first().lang_pred == "und"
    assert op.identify(docs.limit(0), None).count() == 0
