from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose, vocabulary
from wayline.llm import op11_bottomk as op


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return signed(seed)


def shingles(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    return {chain(h[i:i + 5]) for i in range(max(1, len(h) - 4))} if h else set()


def brute_near(a, b, k):
    sa, sb = sorted(a)[:k], sorted(b)[:k]
    union = sorted(set(sa) | set(sb))
    if len(sa) == k or len(sb) == k:
        union = union[:k]
    return len(set(union) & set(sa) & set(sb)) / len(union) if union else 1.0


def text_of(s, k):
    return "".join(f"{h & (2**64 - 1):016x}" for h in sorted(s)[:k])


def brute(rows, k):
    """Multiset of the contract's rows, for distinct (doc_id, text) pairs that are ordered by doc_id alone."""
    t = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, r in enumerate(t):
        text, after = r[1] or "", t[(i + 1) % len(t)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        a, b, c = shingles(text), shingles(edited), shingles(after)
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a, k), text_of(b, k),
                    round(brute_near(a, b, k), 9), round(brute_near(a, c, k), 9)))
    return Counter(out)


def rows_of(df):
    return Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect())


def test_by_brute_force(spark, docs_of):
    rng = random.Random(1)
    words = vocabulary(rng, 60) + ["É", "😀", "Ünï", "x\xa0y"]
    rows = [(i, prose(rng, words, rng.choice([0, 1, 4, 5, 6, 40, 300])) + rng.choice(["", "\n", " \t"]))
            for i in rng.sample(range(-50, 900), 120)]
    rows += [(1000, None), (1001, ""), (None, "a null key"), (2000, prose(rng, words, 40_000))]
    rows += [(3000, rows[0][1])] * 4 + [(3001, rows[0][1])] + [(3002, None)] * 3
    docs = docs_of(rows).withColumn("k1", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("sk", F.lit("x"))
    assert rows_of(op.digests(op.with_edits(docs, k=16), 16)) == brute(rows, 16)


@pytest.mark.parametrize("rows", [[], [(1, "one two three")], [(1, "a b"), (2, None)], [(None, None)] * 2])
def test_small_tables(spark, docs_of, rows):
    assert rows_of(op.digests(op.with_edits(docs_of(rows)))) == brute(rows, op.K)


def test_copies_in_many_runs(spark, docs_of):
    rows = [(1, "a b c d e f g")] * 2500 + [(2, "x y z")]
    assert rows_of(op.digests(op.with_edits(docs_of(rows)))) == brute(rows, op.K)


def test_estimates(spark):
    rng = random.Random(2)
    words = vocabulary(rng, 3000)
    a = prose(rng, words, 4000)
    b = a[:len(a) // 2] + " " + prose(rng, words, 2000)
    df = spark.createDataFrame([(a, b, a[:len(a) // 3])], "a string, b string, c string").select(
        *[op.sketch(F.col(c)).alias(c) for c in "abc"])
    r = df.select(op.resemblance(F.col("a"), F.col("b")).alias("ab"), op.distinct_count(F.col("a")).alias("n"),
                  op.containment(F.col("c"), F.col("a")).alias("ca"), op.containment(F.col("a"), F.col("c")).alias("ac"),
                  (op.from_text(op.to_text(F.col("a"))) == F.col("a")).alias("same")).first()
    sa, sb = shingles(a), shingles(b)
    assert abs(r.ab - len(sa & sb) / len(sa | sb)) < 0.13
    assert abs(r.n / len(sa) - 1) < 0.3
    assert r.ca > 0.7 and abs(r.ac - 1 / 3) < 0.15
    assert r.same


def test_merge_is_the_sketch_of_the_union(spark):
    rng = random.Random(3)
    words = vocabulary(rng, 200)
    rows = [(rng.choice(["hot", "hot", "b", None]), prose(rng, words, rng.choice([0, 3, 30]))) for _ in range(300)]
    rows += [("blank", ""), ("blank", None)]
    parts = spark.createDataFrame(rows, "g string, t string").select("g", op.sketch(F.col("t"), 20).alias("sk"))
    got = {r.g: list(r.sk) for r in op.merge(parts, ["g"], "sk", 20).collect()}
    want = {}
    for g, t in rows:
        want.setdefault(g, set()).update(sorted(shingles(t))[:20])
    assert got == {g: sorted(s)[:20] for g, s in want.items()}


def test_no_python_in_the_plan(spark, docs_of):
    plan = op.digests(op.with_edits(docs_of([(1, "a b c")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
