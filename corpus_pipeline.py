"""Corpus pipeline: stages over ``documents``, each stored before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  The last returns the token ids and
the decoded text of every copy that the mixture shows.

All stages keep columns with other names, whatever they are called, and take
null ids, texts and sources, repeated rows and an empty table: null and blank
texts fail the quality rules; a null source is a source (host) of its own; rows
without an id are no copies of each other; repeated rows are documents of their
own for lines and for the mixture, and stay together in near_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import op3_quality, op4_minhash, op7_sentencepiece, op9_mixing, op10_line_dedup
from wayline.llm.common import WS_CLASS, free_name, stored, table
from wayline.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their host's boilerplate lines."""
    return op3_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents stay once, in the smallest doc_id; rows that lose every line go."""
    lines = free_name(docs, "_lines")
    full = WS_CLASS.replace("[", "[^") + r"[^\n]*"                      # one match for each line with a word
    out = op10_line_dedup.drop_repeated_lines(
        docs.withColumn(lines, F.regexp_count(F.col("text").cast("string"), F.lit(full))), keep_first=True)
    dropped = F.col(out.columns[-1])
    return out.where((dropped == 0) | (dropped < F.col(lines))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return op4_minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, in mixture order: files hold ranges of blocks, and
    rows stand by block and place in them, so each block read in turn has the wanted weights."""
    mixed = op9_mixing.mix(docs)
    order = mixed.columns[-2:]                                          # block, place in it
    # As many files as came in: the encoder that follows runs a task a file.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(docs.inputFiles()))
    return mixed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding."""
    return op7_sentencepiece.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The near-duplicate, mixing and tokenizer stages are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
