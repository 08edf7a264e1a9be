from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import op10_line_dedup as op

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs, keep_first=False):
    held = {}
    for n, (_, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            held.setdefault(k, set()).add(n)
    bad, first = {k for k, v in held.items() if len(v) >= min_docs}, {}
    if keep_first:
        for n, (i, text) in enumerate(rows):
            for j, x in enumerate((text or "").split("\n")):
                if key(x) in bad:
                    place = (i is None, i or 0, j, n)
                    first[key(x)] = min(first.get(key(x), place), place)
    out = []
    for n, (i, text) in enumerate(rows):
        lines = (text or "").split("\n")
        gone = {j for j, x in enumerate(lines) if key(x) in bad and first.get(key(x)) != (i is None, i or 0, j, n)}
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((i, None if text is None else kept, len(lines), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [2, 4])
def test_by_brute_force(spark, docs_of, keep_first, min_docs):
    rng = random.Random(8)
    pool = ["Home", " home\t", "É", "é", "", "  ", "a b", "A  b", "x", "\x0bHOME\r", "long line " * 20] + [f"own {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows += [(None, "home\nx\nx"), (200, None), (201, "")]
    got = op.drop_repeated_lines(docs_of(rows), min_docs, keep_first).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == brute(rows, min_docs, keep_first)


def test_repeated_rows_clashing_names_and_long_texts(spark, docs_of):
    text = "\n".join(["same"] + [f"line {i}" for i in range(50_000)])
    rows = [(1, "same\nown"), (1, "same\nown"), (2, text), (3, "other")]
    docs = docs_of(rows).withColumn("n_lines", F.lit(1)).withColumn("gone", F.lit(1)).withColumn("_t1", F.lit(1))
    got = {(r.doc_id, r.text[:5]): r for r in op.drop_repeated_lines(docs, 3).collect()}
    assert got[1, "own"].n_lines_ == 2 and got[2, "line "].n_dropped == 1 and got[3, "other"].n_dropped == 0
    assert op.drop_repeated_lines(docs, 3).count() == 4
    assert op.drop_repeated_lines(docs.limit(0)).count() == 0


def test_saturated_filters_change_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(op, "LEAST_BITS", 8)
    monkeypatch.setattr(op, "MOST_BITS", 8)
    monkeypatch.setattr(op, "SEGMENT", 8)
    rows = [(i, f"common\nown {i}") for i in range(30)]
    got = op.drop_repeated_lines(docs_of(rows), 10).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == brute(rows, 10)


def test_filters_merge_without_false_negatives(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, "\n".join(f"k{rng.randint(0, 3000)}" for _ in range(5))) for i in range(600)]
    texts = docs_of(rows).repartition(7).select(F.col("text").cast("binary"))
    bits = 2**20
    packed = op.twice_filter(texts, bits)
    held = {}
    for i, t in rows:
        for k in set(t.split("\n")):
            held.setdefault(k, set()).add(i)
    import pyarrow as pa

    names = list(held)
    _, _, h = op.line_keys(pa.array([n.encode() for n in names]))
    hit = np.ones(len(names), bool)
    for at in op._bits(h[:, 0], bits):
        hit &= ((packed[at >> 3] >> (7 - (at & 7))) & 1).astype(bool)
    assert all(hit[i] for i, n in enumerate(names) if len(held[n]) > 1)
    assert sum(hit[i] for i, n in enumerate(names) if len(held[n]) == 1) < 20


def test_packed_filters_against_sets():
    """Packed once and twice filters of a partition, and the memory that a large filter takes."""
    import resource

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["\n".join(f"line {x}" for x in rng.integers(0, 4000, 30)).encode() for _ in range(300)]
    batches = [pa.RecordBatch.from_pydict({"t": pa.array(texts[i:i + 70], pa.binary())}) for i in range(0, 300, 70)]
    bits = 2**20
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    for t in texts:
        _, _, h = op.line_keys(pa.array([t], pa.binary()))
        for at in op._bits(h[:, 0], bits):
            hit = np.unique(at)
            twice[hit[once[hit]]] = True
            once[hit] = True
    got = {r["seg"]: r for b in op._local_filters(bits)(iter(batches)) for r in b.to_pylist()}
    for k, name in ((once, "once"), (twice, "twice")):
        packed = b"".join(got[s][name] if s in got else bytes(op.SEGMENT // 8) for s in range(bits // op.SEGMENT))
        # The two hashes of a document are counted apart, so a bit may be set twice by one document: never too few.
        mine = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        assert (mine >= k).all() and (mine != k).sum() <= 20
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in op._local_filters(op.MOST_BITS)(iter(batches)):
        pass
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 * 1024      # KB
