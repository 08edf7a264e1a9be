"""Row positions and predecessors within a group, without one task per group.

``row_number()`` / ``lag()`` over ``partitionBy(key)`` send a whole group to
one task; with a key holding a third of the rows that task holds a third of
the data.  The helpers here compute the same values in bounded pieces:

* rows are range-partitioned and sorted on (group, order), so a hot group is
  spread over many partitions and every row's place in its partition is known;
* per (group, partition) the first place and the number of rows give running
  offsets, a table of as many rows as there are groups and partitions;
* position = offset + place in the partition - first place;
* a row's predecessor is found by an equi-join on (group, position - 1),
  which is 1:1 and has no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import checkpoint_dir

_PLACE_BITS = 33          # monotonically_increasing_id: partition above, place in the partition below


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row (maps, which Spark does not hash, as JSON)."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in df.dtypes])


def position_within(df: DataFrame, part_cols: str | list[str], order_col: str, out_col: str = "pos",
                    n_ranges: int | None = None) -> DataFrame:
    """1-based position of every row within ``part_cols`` by ``order_col``.

    NULLs come first and rows that tie are ordered by a hash of all their
    columns, so each row has a place, also in a batch whose order key is
    missing or repeated; only rows equal in every column may swap places.
    """
    tie = "_tie"
    while tie in df.columns:
        tie += "_"
    hashed = df.withColumn(tie, row_hash(df))
    part = [part_cols] if isinstance(part_cols, str) else list(part_cols)
    return ordered_position(hashed, part, [order_col, tie], n_ranges, out_col).drop(tie)


def ordered_position(df: DataFrame, part_cols: list[str], order_cols: list[str],
                     n_ranges: int | None = None, out_col: str = "pos") -> DataFrame:
    """1-based position within ``part_cols`` ordered by ``order_cols``
    (ascending, NULLs first; rows that tie on all of them are in no fixed order).

    Spark samples the key distribution for the ranges, so a hot group is spread
    over many partitions.  The sorted rows are checkpointed (shared checkpoint
    folder) before their places are used twice: a range partitioner re-planned in
    each branch would sample its own boundaries and the branches would disagree.
    The rows themselves move once; after that only the offsets are joined.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*part_cols, *order_cols]]
    d = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    d = d.checkpoint(eager=True).withColumn("_blk", F.shiftright("_m", _PLACE_BITS))
    run = Window.partitionBy(*[f"_p_{c}" for c in part_cols]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (d.groupBy(*[F.col(c).alias(f"_p_{c}") for c in part_cols], F.col("_blk").alias("_b"))
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
              .withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0)) - F.col("_first") + 1).drop("_n", "_first"))
    cond = d["_blk"] == starts["_b"]
    for c in part_cols:
        cond = cond & d[c].eqNullSafe(starts[f"_p_{c}"])
    joined = d.join(starts, cond, "left")
    return joined.select(*[F.col(c) for c in df.columns if c != out_col],
                         (F.col("_off") + F.col("_m")).cast("bigint").alias(out_col))


def with_previous(df: DataFrame, part_cols: list[str], order_cols: list[str],
                  carry: list[str], prefix: str = "prev_") -> DataFrame:
    """Attach the previous row's ``carry`` columns (``lag``) per group.

    The first row of a group gets NULLs and ``has_prev = false``.
    """
    p = ordered_position(df, part_cols, order_cols, out_col="_pos")
    prev = p.select(*[F.col(c).alias(f"_k_{c}") for c in part_cols],
                    (F.col("_pos") + 1).alias("_next"),
                    *[F.col(c).alias(f"{prefix}{c}") for c in carry])
    cond = p["_pos"] == prev["_next"]
    for c in part_cols:
        cond = cond & p[c].eqNullSafe(prev[f"_k_{c}"])
    out = p.join(prev, cond, "left")
    return (out.withColumn("has_prev", F.col("_next").isNotNull())
            .drop("_pos", "_next", *[f"_k_{c}" for c in part_cols]))
