from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF01
from wayline.llm import op7_sentencepiece as op
from wayline.llm.queries import QUERIES, tokenizer_path

with open(tokenizer_path(), "rb") as _f:
    _PROTO = _f.read()
LIB = sentencepiece.SentencePieceProcessor(model_proto=_PROTO)
MODEL = op.PieceModel(_PROTO)
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet=" ▁aehnrst.,('\n\t0é中😀", max_size=60))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_encodes_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = MODEL.encode(text)
    assert ids.tolist() == LIB.encode(text)
    assert MODEL.decode(ids) == LIB.decode(ids.tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258)), max_size=12))
def test_decodes_any_ids_as_the_library(ids):
    assert MODEL.decode(np.array(ids, dtype=np.int64)) == LIB.decode(ids)


def test_pieces_runs_and_small_tables(monkeypatch):
    monkeypatch.setattr(op, "REMEMBER_WORDS", 5)
    monkeypatch.setattr(op, "REMEMBER_PAIRS", 5)
    model, rng = op.PieceModel(_PROTO), random.Random(4)
    pieces = [LIB.id_to_piece(i) for i in range(259, 32000)]
    for k in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace("▁", " ") + " " * rng.randint(0, 40)
        assert model.encode(text).tolist() == LIB.encode(text)


def test_long_words():
    rng = random.Random(5)
    for text in ("a" * 5000, "".join(rng.choice("abcdefghij0123/+") for _ in range(20_000)), "中文字符" * 2000):
        assert MODEL.encode(text).tolist() == LIB.encode(text)


def test_query_against_the_library(spark):
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece_codec"](spark, SF01).collect()}
    for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect():
        ids = LIB.encode(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_edges(spark, docs_of, monkeypatch):
    rows = [(1, None), (2, ""), (3, " "), (None, "x y"), (4, "z"), (4, "z")]
    docs = docs_of(rows).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    got = op.encode_decode(docs, tokenizer_path()).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].ids == [] and by[1].decoded == "" and by[2].ids == []
    assert by[3].decoded == " " and by[None].decoded == "x y" and by[4].ids == LIB.encode("z")
    assert op.digests(op.encode_decode(docs.limit(0), tokenizer_path())).count() == 0
    monkeypatch.setattr(op, "MODEL_LIMIT", 10)
    with pytest.raises(ValueError):
        op.encode_decode(docs, tokenizer_path())
