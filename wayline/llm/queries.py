"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import (
    op1_ann, op2_language, op3_quality, op4_minhash, op5_licences, op6_secrets, op7_sentencepiece, op8_chat,
    op9_mixing, op10_line_dedup, op11_bottomk, op12_merkle, op13_collocations)
from wayline.llm.common import sha_hex, table


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trained = op2_language.train(docs.where(~op2_language.held_out(F.col("doc_id"))).select("text", "lang"))
    return op2_language.identify(docs, trained).select(
        "doc_id", op2_language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality.assess(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lost_words")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op5_licences.summary(op5_licences.scan(docs, op5_licences.train(docs)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets.digests(op6_secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = op7_sentencepiece.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return op7_sentencepiece.digests(coded)


def op8_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    nodes, leaves = op8_chat.format_tree(talks.unionByName(extra))
    return op8_chat.digests(op8_chat.read_back(nodes, leaves), leaves)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op10_line_dedup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op10_line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", sha_hex(kept).alias("kept_sha256"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_bottomk.digests(op11_bottomk.with_edits(table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op12_merkle.document_rows(table(spark, sf_dir, "documents"))
    return op12_merkle.digests(op12_merkle.climb(op12_merkle.build(rows)))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_collocations.report(op13_collocations.collocations(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ann_search, op2_language_id, op3_quality_rules, op4_minhash_near_dedup, op5_licence_scan, op6_secret_scan,
        op7_sentencepiece_codec, op8_chat_prefix_tree, op9_source_mixing, op10_line_dedup_bloom, op11_document_fingerprints,
        op12_merkle_manifest, op13_phrase_collocations)
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": op3_quality.ORACLE_SQL,
    "op4_minhash_near_dedup": op4_minhash.ORACLE_SQL,
    "op8_chat_prefix_tree": op8_chat.ORACLE_SQL,
    "op10_line_dedup_bloom": op10_line_dedup.ORACLE_SQL,
    "op12_merkle_manifest": op12_merkle.ORACLE_SQL,
    "op13_phrase_collocations": op13_collocations.ORACLE_SQL,
}
