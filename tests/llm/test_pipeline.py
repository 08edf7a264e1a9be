"""The corpus pipeline, stage by stage, against brute force on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tests.conftest import SF001
from tests.llm.conftest import prose, vocabulary
from tests.llm.test_op4_minhash import brute
from tests.llm.test_op10_line_dedup import brute as brute_lines
from wayline.llm.common import stored
from wayline.llm.queries import tokenizer_path


def test_stage_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF001), f"test-{name}")
        assert docs.count() > 0
        if name != "encode":
            assert docs.columns == columns


def test_stages_by_brute_force(spark, docs_of):
    rng = random.Random(12)
    words = vocabulary(rng)
    rows = [(i, prose(rng, words, 40) + ("\nShared footer line of many documents" if i % 2 else "")) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more"), (102, "too short"), (103, None)]
    docs = docs_of(rows)
    stages = dict(corpus_pipeline.STAGES)
    good = stored(stages["quality_rules"](spark, docs, ""), "test-good")
    assert {r.doc_id for r in good.collect()} == {i for i, t in rows if t and len(t.split()) >= 10}
    before = [(r.doc_id, r.text) for r in good.collect()]
    lines = stored(stages["line_dedup"](spark, good, ""), "test-lines")
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == [x[:2] for x in brute_lines(before, 10)]
    before = [(r.doc_id, r.text) for r in lines.collect()]
    single = stored(stages["near_dedup"](spark, lines, ""), "test-single")
    assert {r.doc_id for r in single.collect()} == {i for i, root in brute(before).items() if i == root}
    mixed = stored(stages["mix_sources"](spark, single, ""), "test-mixed")
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    coded = stages["encode"](spark, mixed, "").collect()
    assert len(coded) == mixed.count()
    assert all(r.ids == lib.encode(texts[r.doc_id]) and r.decoded == lib.decode(r.ids) for r in coded)


def test_many_copies_leave_one_whole_text(spark, docs_of):
    rng = random.Random(13)
    words = vocabulary(rng)
    whole = "\n".join(prose(rng, words, 12) for _ in range(4)) + "\n\n"
    rows = [(5 + i, whole) for i in range(12)] + [(40 + i, f"{whole}{prose(rng, words, 30)}") for i in range(12)]
    rows += [(80, prose(rng, words, 40)), (81, None), (82, "")]
    stages = dict(corpus_pipeline.STAGES)
    lines = stored(stages["line_dedup"](spark, docs_of(rows), ""), "test-copies")
    left = {r.doc_id: r.text for r in stages["near_dedup"](spark, lines, "").collect()}
    own = {i: t.removeprefix(whole) for i, t in rows[12:24]}
    assert left.keys() == {5, 80, 81, 82} | own.keys()
    assert left[5] == whole and left[80] == rows[24][1] and left[81] is None and left[82] == ""
    assert all(left[i].strip() == t for i, t in own.items())


def test_mixture_order_reaches_the_output(spark):
    from wayline.llm import op9_mixing

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    mixed = op9_mixing.mix(docs)
    want = [(r.mix_block, r.mix_place, r.doc_id) for r in mixed.collect()]
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)["mix_sources"](spark, docs, SF001).collect()]
    assert got == [d for _, _, d in sorted(want)]


def test_stages_on_edges(spark, docs_of):
    """Null ids, texts and sources, repeated rows and clashing column names; and an empty table."""
    rng = random.Random(14)
    words = vocabulary(rng)
    texts = [prose(rng, words, 40) for _ in range(12)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None)] * 2
    rows += [(3, texts[3], "en", "s", 1)] * 2 + [(90, None, "en", None, None), (91, "", None, "s", 0), (92, texts[4], "en", None, 5)]
    clash = ["_gone", "_lines", "n_tokens", "mix_block", "mix_place", "epoch", "h1", "kept", "n_lines", "_text", "gone", "src"]
    docs = docs_of(rows)
    for c in clash:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, table, ""), f"test-edge-{name}")
            assert out.columns[:len(docs.columns)] == docs.columns or name == "encode"
            if name != "encode":
                assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in out.collect() for c in clash)
                table = out
        if table.isEmpty():
            assert out.count() == 0
    # Of the copies 4 and 92 the smaller id stays, repeated rows and rows without an id stay as they are.
    ids = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()]
    assert sorted(ids, key=str) == sorted([*range(12), 3, 3, None, None, 90, 91], key=str)
