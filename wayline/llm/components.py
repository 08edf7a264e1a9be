"""Connected components of an edge table by alternating large-star / small-star steps.

Both steps only re-hang each vertex onto the smallest vertex that it sees,
so a step is one grouped minimum and one join; the edge count never grows
beyond the input's.  Labels stay in the cluster: the driver reads one
fingerprint (count and sum of hashes) per round to notice the fixed point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import stored


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both(e)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): comp is the smallest node reachable.  Only nodes with an edge to another appear.

    Null ends and self-loops are ignored; repeated edges count once; an empty
    table gives no rows.
    """
    e = (edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
         .where("u <> v").distinct())
    e = stored(e, "edges")
    mark = _mark(e)
    while mark[0]:
        e = stored(_small_star(_large_star(e)), "edges")
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct())
