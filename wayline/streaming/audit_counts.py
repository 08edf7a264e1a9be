"""Live audit counts per action in tumbling windows (Structured Streaming).

The audit log is read as a file stream.  Every micro-batch counts its own
rows per (window, action) and writes these partial counts to the batch's
folder; readers add them up.  Counts add in any order, so the result does not
depend on how the table is split into files or on the order in which they
arrive: no row is late, none is dropped, and no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.sources.views import VIEWS
from wayline.streaming.files import read_batches, run_available_now, stream_table, write_batch

OUTPUT = "counts"
COUNTS = T.StructType([T.StructField("window_start", T.TimestampNTZType()), T.StructField("window_end", T.TimestampNTZType()),
                       T.StructField("action", T.StringType()), T.StructField("cnt", T.LongType())])


def view_columns(view: str, names: list[str]) -> list[str]:
    """``expr AS name`` strings of a view's mapping (for streaming inputs)."""
    cols = dict(VIEWS[view][1])
    return [f"{cols[n]} AS {n}" for n in names]


def audit_stream(spark: SparkSession, data_dir: str, max_files: int = 8) -> DataFrame:
    """Stream of audit rows (action, created_at) from the events table."""
    path = f"{data_dir}/events.parquet"
    events = stream_table(spark, path, spark.read.parquet(path).schema, max_files)
    return events.selectExpr(*view_columns("crm_activity_logs", ["id", "action", "created_at"]))


def window_counts(audit: DataFrame, window: str = "1 day") -> DataFrame:
    """Rows per (tumbling window of the event time, action)."""
    ts = audit.withColumn("event_time", F.col("created_at").cast("timestamp"))
    g = ts.groupBy(F.window("event_time", window).alias("w"), "action").agg(F.count(F.lit(1)).alias("cnt"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "action", "cnt")


def run_counts(audit: DataFrame, out_path: str, checkpoint: str, window: str = "1 day",
               timeout_s: float | None = None) -> None:
    """Count everything available, one output folder per micro-batch."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(window_counts(batch, window), out_path, OUTPUT, batch_id)

    run_available_now(audit.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint), timeout_s)


def final_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """Counts over all batches."""
    return (read_batches(spark, out_path, OUTPUT, COUNTS).groupBy("window_start", "window_end", "action")
            .agg(F.sum("cnt").alias("cnt")))


#: Batch twin of the stream.
batch_counts = window_counts
