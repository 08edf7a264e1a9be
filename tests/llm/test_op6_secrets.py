from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.conftest import prose, vocabulary
from wayline.llm import op6_secrets as op

ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in op.KEYWORDS)
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(s)


def listing(spans):
    return ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_by_brute_force(spark, docs_of):
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret=token:abcdefghijklmnop", "api_key", "apikey", ": ", " = ", "=", '"', "'", " ", "\n",
            "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef", "0123456789abcdef", "é", "😀", "x-y.z", "ſecret", "ABCDEFGHIJKL", "toKen"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (None, "password=abcdefghijkl"), (0, texts[0])]
    docs = docs_of(rows).withColumn("spans", F.lit(1)).withColumn("_text", F.lit(1))
    got = op.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [(s.start, s.kind, s.end) for s in r["spans_"] if s.kind < 3]
        assert mine == base(r.text or "")
    d = {r.doc_id: r for r in op.digests(op.scan(docs_of(rows))).collect()}
    for i, t in enumerate(texts):
        assert d[i].base_sha256 == hashlib.sha256(listing(base(t)).encode()).hexdigest()
        assert d[i].n_assign == sum(k == 0 for _, k, _ in base(t))
    assert d[1000].spans == "" and d[1000].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert op.scan(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    words = vocabulary(rng, 3000)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    plain = [(i, prose(rng, ["the", "counter", "value", "request", "handler", "configuration", *words], 60))
             for i in range(200)]
    known = [(1000 + i, f"here password={key(24)} ends") for i in range(200)]
    bare = [(2000 + i, f"note {key(30)}7a ends") for i in range(40)]
    names = ["user_profile_request_handler2", "get_configuration_value_by_name3", "internal-request-counter-total9",
             "requestHandlerConfigurationValue4"]
    common = [(3000 + i, f"call {names[i % len(names)]} here") for i in range(40)]
    return plain, known, bare, common


def test_markov_finds_bare_keys_and_leaves_identifiers(spark, docs_of, labelled):
    plain, known, bare, common = labelled
    got = {r.doc_id: r for r in op.digests(op.scan(docs_of(plain + known + bare + common))).collect()}
    assert sum(got[i].n_markov == 1 for i, _ in bare) >= 38
    assert sum(got[i].n_markov for i, _ in common) == 0
    assert all(got[i].n_assign == 1 and got[i].n_markov == 0 for i, _ in known)


def test_rare_secrets_of_a_corpus_larger_than_the_sample(spark, docs_of, labelled, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE_DOCS", 100)          # about 3 of the 50 documents with secrets fall in the sample
    plain, known, bare, common = labelled
    many = [(10_000 + 200 * k + i, t) for k in range(9) for i, t in plain]
    got = {r.doc_id: r for r in op.digests(op.scan(docs_of(many + known[:50] + bare + common))).collect()}
    assert sum(got[i].n_markov == 1 for i, _ in bare) >= 36
    assert sum(got[i].n_markov for i, _ in common) == 0


def test_labelled_strings_are_those_of_the_base_spans(spark, docs_of):
    rng = random.Random(4)
    bits = ["password", "secret=token:abcdefghijklmnop", "api_key", ": ", "=", '"', " ", "AKIAABCDEFGHIJKLMN", "deadbeef",
            "0123456789abcdef", "é", "x-y.z", "ABCDEFGHIJKL"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    df = docs_of(list(enumerate(texts)))
    for r in df.select("text", op._labelled(F.col("text")).alias("got"), op.base_spans(F.col("text")).alias("base")).collect():
        assert sorted(r.got) == sorted(ASSIGN.match(b.hit).group(2) if b.kind == 0 else b.hit for b in r.base)


def test_scores_by_brute_force(spark, docs_of, labelled):
    ratios = op.log_ratios({("a", "b"): 3, ("b", "1"): 2}, {("a", "b"): 1})
    k = len(op.ALPHABET)
    at = op.ALPHABET.index("a") * k + op.ALPHABET.index("b")
    # a -> b: (3 + 5 * P(b)) / (3 + 5) with P(b) = (3 + 1) / (5 + k) against (1 + 5 * 2 / (1 + k)) / (1 + 5)
    assert ratios[at] == round(1e6 * math.log((3 + 5 * 4 / (5 + k)) / 8 / ((1 + 5 * 2 / (1 + k)) / 6)))
    table = F.array(*(F.lit(x).cast("long") for x in ratios))
    df = spark.createDataFrame([("ab1",), ("b",), ("",)], "s string")
    got = [r.g for r in df.select(op._gain(F.col("s"), table).alias("g")).collect()]
    second = ratios[op.ALPHABET.index("b") * k + op.ALPHABET.index("1")]
    assert got == [ratios[at] + second, 0, 0]


def test_native_plan(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    plan = op.digests(op.scan(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_text_of_very_many_spans(spark, docs_of):
    """Linear in the spans of a text: a hash list of 60,000 lines, and candidates beside base spans."""
    import time

    rng = random.Random(8)
    lines = [rng.choice([f"{rng.getrandbits(64):016x}", f"token={rng.getrandbits(60):x}zzzzzzzzzzzz", "Zz9_" + "Ab1-" * 6,
                         f"Qq8/{rng.getrandbits(70):018x}", "plain words"]) for _ in range(60_000)]
    text = "\n".join(lines)
    began = time.time()
    one = docs_of([(1, text)]).select(op.base_spans(F.col("text")).alias("b"),
                                      op._candidates(F.col("text"), op.base_spans(F.col("text"))).alias("c")).first()
    took = time.time() - began
    want = base(text)
    assert [(s.start, s.kind, s.end) for s in one.b] == want and len(want) > 30_000
    tokens = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text)
              if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    starts = [s for s, _, _ in want]
    import bisect

    def free(a, b):
        i = bisect.bisect_left(starts, b)
        return all(e <= a for _, _, e in want[max(0, i - 4):i])

    assert [(c.start, c.end) for c in one.c] == [t for t in tokens if free(*t)] and len(one.c) > 5000
    assert took < 30, took
