"""Tables as file streams, and micro-batch outputs as one folder per batch.

A batch's output is written to its own ``batch_id=<n>`` folder in overwrite
mode: a replayed batch replaces what it wrote before, so nothing is counted
twice and no commit log is needed.  Readers see one partitioned table.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is one file (an empty or absent folder is none); only names are listed."""
    first = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    return bool(first) and first[0].path.endswith(path.split("://")[-1].rstrip("/"))


def stream_table(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 8) -> DataFrame:
    """File stream of a Parquet table, whether ``path`` is a folder of files or a single file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if not _is_file(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def batch_folder(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch_id={batch_id}"


def write_batch(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(root, name, batch_id))


def has_batches(spark: SparkSession, root: str, name: str) -> bool:
    """Whether any batch of an output was written."""
    try:
        return bool(spark.read.parquet(f"{root}/{name}").columns)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def read_batches(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """All batches of an output; with ``schema``, an output without any batch is empty."""
    if schema is None:
        return spark.read.parquet(f"{root}/{name}").drop("batch_id")
    if not has_batches(spark, root, name):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}").drop("batch_id")


def run_available_now(writer, timeout_s: float | None = None) -> None:
    """Start a configured ``writeStream`` over everything available and wait for its end.

    Waits without limit unless ``timeout_s`` is given; then an unfinished
    query is stopped and ``TimeoutError`` raised.
    """
    query = writer.trigger(availableNow=True).start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError("streaming query did not finish")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
