from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wayline.llm import op12_merkle as op
from wayline.llm.op12_merkle import ROW_LIMIT


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return sha("".join(field(v) for v in (r[0], r[3], r[2], n, r[1])))


def tree(hashes):
    """(root, proof of every leaf: list of (sibling or None, sibling stands left))."""
    proofs, where, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(where):
            q = p ^ 1
            proofs[i].append((level[q] if q < len(level) else None, q < p))
        level = [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        where = [p // 2 for p in where]
    return level[0], proofs


def brute(rows):
    """Multiset of the contract's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[g] = tree([leaf(r) for r in groups[g]])
    root, tops = tree([inner[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for r, proof in zip(groups[g], inner[g][1]):
            path = proof + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, int(bad))
            for s, left in path:
                h = sha((s or "") + h if left else h + (s or ""))
            out.append((r[0], leaf(r), inner[g][0], root, sha("".join(s for s, _ in path if s)), h, h == root))
    return out


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def rows_of(rng, n, langs):
    out = [(i, f"text {rng.random()} é\n" * rng.randint(0, 3), rng.choice(langs), rng.choice(["a", None, "ü"]),
            rng.choice([None, 0, 12345])) for i in rng.sample(range(10 * n), n)]
    return out


@pytest.mark.parametrize("stride", [1, 8])
def test_by_brute_force(spark, docs_of, stride):
    rng = random.Random(stride)
    rows = rows_of(rng, 90, ["en", "en", "de", None, "Zz", "é"]) + [(None, None, None, None, None)] * 2
    rows += [(7, "x", "en", "s", 1)] * 3 + [(7, "y", "en", "s", 1), (8, "", "only", "s", 0)]
    docs = docs_of(rows)
    docs = docs.withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("proof", F.lit(2)).withColumn("key", F.lit(3))
    got = op.digests(op.climb(op.build(op.document_rows(docs), stride))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    assert {r.verified for r in got} == {True, False}


def test_tree_sizes_and_many_groups(spark, docs_of):
    sizes = [1, 2, 3, 4, 5, 8, 16, 17, *[1] * 15]
    rows = [(100 * g + i, "t", f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    got = op.digests(op.climb(op.build(op.document_rows(docs_of(rows)), 2))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_one_group(spark, docs_of):
    rows = [(i, "t", "en", "s", 1) for i in range(5)]
    got = op.digests(op.climb(op.build(op.document_rows(docs_of(rows)), 2))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_lanes_split_the_high_nodes(spark, docs_of, monkeypatch):
    """With lanes of four leaves every stored node serves at most four leaves a row."""
    monkeypatch.setattr(op, "LANE_BITS", 2)
    monkeypatch.setattr(op, "CLIMB", op.CLIMB.replace("shiftright(pos, 16)", "shiftright(pos, 2)"))
    rows = [(i, "t", "en" if i % 3 else "de", "s", 1) for i in range(70)]
    m = op.build(op.document_rows(docs_of(rows)), 2)
    lanes = op._lanes(m)
    assert lanes.groupBy("leaf_tree", "lane", "tree", "level", "pos").count().where("count > 1").isEmpty()
    root = lanes.where((F.col("tree") == op.TOP) & F.col("parent_tree").isNull())
    assert root.count() == sum((n + 3) // 4 for n in (24, 46))
    got = op.digests(op.climb(m)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_empty_and_long(spark, docs_of):
    before = spark.conf.get(ROW_LIMIT)
    assert op.digests(op.climb(op.build(op.document_rows(docs_of([]))))).count() == 0
    assert spark.conf.get(ROW_LIMIT) == before
    rows = [(1, "é" * 3_000_000, "en", "s", 3_000_000), (2, "", "en", "", 0)]
    got = op.digests(op.climb(op.build(op.document_rows(docs_of(rows))))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
