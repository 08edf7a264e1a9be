"""Helpers shared by the operators: shared-folder tables and Column snippets."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.session import scratch_path

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows and bytes of one Arrow batch between the JVM and a Python worker.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
               "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 2**20)}

#: ASCII white space of every word and line rule of this package.
WS = " \t\n\x0b\x0c\r"
#: The same as a regular-expression class that Java, Python and RE2 read alike.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Cuts lineage in a way that survives lost executors: the files are on
    storage that all executors share.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words(c: Column) -> Column:
    """Array of the words of a text (none for null)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS_CLASS + "+"), lambda w: w != "")


def hash128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; together the 128-bit key of a string."""
    return F.xxhash64(c), F.xxhash64(F.lit(7919), c)


def sha_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def hash_share(h: Column, share: Column | float) -> Column:
    """Whether a 64-bit hash falls in the first ``share`` of its range."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(2**53)) < share


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is installed or shipped (``--py-files``); the
    extra path only helps runs from a checkout.  Also bounds the Arrow batches
    of the session, since a batch is held whole on both sides.
    """
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), _ROOT) if x)


def arrow_map(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, ddl)
