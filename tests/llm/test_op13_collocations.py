from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayline.llm import op13_collocations as op


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, longest=5, limit=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for j in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + j])) for i in range(len(w) - j + 1))
    f = {k: c for k, c in f.items() if c >= least}
    lost = set()
    for (lang, p), c in f.items():
        for j in range(2, len(p)):
            lost |= {(lang, p[i:i + j]) for i in range(len(p) - j + 1) if c >= f[lang, p[i:i + j]]}
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in lost:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, x, r, n[lang], -s) for lang, found in out.items()
            for i, (s, a, p, x, r) in enumerate(sorted(found)[:limit], 1)]


def texts(rng, n, words):
    seps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " \r\n", "! ", "\x0b", ";", " - "]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("longest", [2, 5])
def test_by_brute_force(spark, docs_of, longest):
    rng = random.Random(3)
    words = ["the", "The", "cat", "é", "İX", "a\x00b", "x\xa0y", "sat", "on", "new york", "new york city", "und", "ſ"]
    rows = [(i, t, rng.choice(["en", "en", "de", None, "und", ""]), "s", 1) for i, t in enumerate(texts(rng, 300, words))]
    rows += [(1, rows[0][1], "en", "s", 1)] * 5 + [(None, None, None, None, None), (5, "", "en", "s", 0), (6, " .\n", "fr", "s", 3)]
    rows += [(7, "once upon a time there was " * 20, "xx", "s", 1)]
    docs = docs_of(rows).withColumn("f", F.lit(1)).withColumn("prefix", F.lit("p")).withColumn("word", F.lit("w"))
    got = op.report(op.collocations(docs, min_count=4, max_words=longest)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, longest))
    assert len(got) > 50
    few = op.report(op.collocations(docs, min_count=4, max_words=longest), 7).collect()
    assert sorted(map(tuple, few)) == sorted(brute(rows, 4, longest, 7))


def test_subsumed_phrases_go(spark, docs_of):
    rows = [(i, "alpha beta gamma delta epsilon zeta. alpha beta", "en", "s", 1) for i in range(3)]
    got = {r.phrase for r in op.collocations(docs_of(rows), min_count=3).collect()}
    assert got == {"alpha beta", "alpha beta gamma delta epsilon", "beta gamma delta epsilon zeta"}


def test_blocks_do_not_change_counts(spark, docs_of, monkeypatch):
    """A block per text, in the worker's own function, gives the stripes of one block."""
    import pyarrow as pa

    rng = random.Random(5)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 20, "text": texts(rng, 40, ["a", "b", "c", "Dd", "é"])})

    def counts():
        out = Counter()
        for run in (op._words, op._longer({}, 5)):
            for b in run(iter([batch])):
                for r in b.to_pylist():
                    for w, c in zip(r["words"].split(" "), r["counts"]):
                        out[r["lang"], r["prefix"], w] += c
        return out

    whole = counts()
    monkeypatch.setattr(op, "BLOCK", 1)
    assert counts() == whole
    monkeypatch.setattr(op, "HELD", 200)
    assert counts() == whole
    monkeypatch.setattr(op, "HELD", 1)
    assert counts() == whole
    monkeypatch.setattr(op, "_number", lambda codes, bound: __import__("numpy").unique(codes, return_inverse=True))
    assert counts() == whole


def test_filter_holds_every_key():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    words = np.zeros(2**16 // 64, np.uint64)
    for p in op._places(h[:2500], 2**16):
        np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
    assert op._holds(words, h[:2500]).all()
    assert op._holds(words, h[2500:]).mean() < 0.05


def test_segments_find_every_frequent_key(monkeypatch):
    """Counted over blocks and segments, hashed phrases that reach the threshold are all among the keys."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 200, "text": texts(rng, 200, [f"w{i}" for i in range(30)])})
    monkeypatch.setattr(op, "BLOCK", 2000)
    for bits, least in ((8, 5), (13, 5), (8, 300)):
        exact = Counter()
        for block in op._texts(iter([batch])):
            for length, _, _, counts, h in op._Block(*block).phrases(3, op._keep({})):
                exact.update(dict(zip((h >> np.uint64(16)).tolist(), counts.tolist())) if length > 1 else {})
        got, rows = set(), {}
        for b in op._hashed({}, 2, 3, bits, least)(iter([batch])):
            for r in b.to_pylist():
                rows.setdefault(r["segment"], []).append(r)
        for segment, group in rows.items():
            got |= set(op._frequent_keys(least, bits)(pa.Table.from_pylist(group))["key"].to_pylist())
        assert got == {k for k, n in exact.items() if n >= least}
        assert bool(got) == (least == 5)


def test_large_counts_are_exact(spark):
    a, n = 2**60, 2**62
    got = spark.sql(f"SELECT CAST(CAST({a}L AS decimal(38,0)) * 1000 div (CAST(7 AS decimal(38,0)) * {n}L) AS bigint) AS s").first()
    assert got.s == a * 1000 // (7 * n)


def test_empty_table(spark, docs_of):
    assert op.report(op.collocations(docs_of([]))).count() == 0
    assert op.report(op.collocations(docs_of([(1, None), (2, " ., ")]))).count() == 0
