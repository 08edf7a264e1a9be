"""Typed reads, schema conforming and file sinks.

Reads always carry a declared schema; writes go through Spark writers, so on
a cluster every path is shared storage (the scratch location is the session's
``spark.checkpoint.dir``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.sources.schemas import DEFAULTS, SCHEMAS

CORRUPT = "_corrupt_record"
CSV_TEXT = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""',
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
EMPTY_MARK = "\x00"            # what the reader gives for a quoted empty field; an unquoted one is NULL
TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None,
            keep_extra: bool = False) -> DataFrame:
    """Cast present columns to the declared types; add absent ones
    with their default (or NULL) -- "ADD COLUMN IF NOT EXISTS" for a read."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols)


def conform_entity(df: DataFrame, entity: str, only_present: bool = False) -> DataFrame:
    """Conform a CRM entity; ``only_present`` keeps just the columns it has."""
    schema = SCHEMAS[entity]
    if only_present:
        schema = T.StructType([f for f in schema.fields if f.name in df.columns])
    return conform(df, schema, DEFAULTS.get(entity, {}))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet scan with a declared schema (filters and pruning pushed down)."""
    return spark.read.schema(schema).parquet(path)


def load_typed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
               header: bool = True) -> DataFrame:
    """Bulk typed load of CSV / JSON rows.

    PERMISSIVE mode keeps malformed rows: their fields are NULL and the raw
    line is kept in ``_corrupt_record`` so they can be split out as rejects.
    CSV fields may hold line breaks and doubled quotes; an empty field is NULL
    and a quoted empty one is the empty string.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    reader = (spark.read.schema(with_corrupt).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT))
    if fmt == "csv":
        rows = (reader.option("header", header).options(**CSV_TEXT | {"emptyValue": EMPTY_MARK})
                .option("multiLine", True).option("timestampNTZFormat", TIMESTAMPS).csv(path))
        return rows.select(*[F.when(F.col(f.name) == EMPTY_MARK, "").otherwise(F.col(f.name)).alias(f.name)
                             if isinstance(f.dataType, T.StringType) and f.name != CORRUPT else F.col(f.name)
                             for f in with_corrupt.fields])
    if fmt == "json":
        return reader.json(path)
    raise ValueError(fmt)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV export with a header row (one file per partition); quotes inside a field are doubled."""
    df.write.mode(mode).option("header", True).options(**CSV_TEXT).option("timestampNTZFormat", TIMESTAMPS).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON-lines export of (nested) documents."""
    df.write.mode(mode).json(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Append rows to a Parquet table as the batch ``batch``, once.

    Each batch is a folder of its own, written in overwrite mode: a retry after
    a failure, or a batch sent twice, replaces what the first attempt left and
    adds nothing.  Batches do not touch each other, so writers of different
    batches may run at the same time.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch is named by letters, digits, '_', '.' and '-'")
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches of a table, with the ``batch`` that each came with."""
    columns = T.StructType([f for f in schema.fields if f.name != "batch"] + [T.StructField("batch", T.StringType())])
    return spark.read.schema(columns).parquet(path)
