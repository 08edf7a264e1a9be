"""Change-sets as micro-batches (``foreachBatch`` with one output folder per batch).

Incoming conversation requests arrive as a file stream.  Every micro-batch
runs the batch operator (``apply_conversations``) against the leads that its
requests name and writes each output (conversations, follow-ups, audit rows,
lead status changes, rejects) to the batch's own folder in overwrite mode: a
replayed batch writes the same folders again.

The current status of a lead is its latest change (by request ``seq``), resolved
at read time, so no table is rewritten per micro-batch and the result does not
depend on how requests are split into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.changes import apply_conversations
from wayline.session import checkpoint_dir
from wayline.streaming.files import has_batches, read_batches, run_available_now, write_batch

NO_REQUESTS = -1         # the batch folder of a stream that met no request
OUTPUTS = ("conversations", "followups", "activity_logs", "lead_status_changes", "rejects")


def conversation_requests(events: DataFrame, n_leads: int, n_users: int) -> DataFrame:
    """Shape raw events into conversation requests (stand-in request feed)."""
    e = events.where(F.col("event_type").isin("view", "click", "purchase"))
    result = F.expr("CASE event_id % 9 WHEN 0 THEN 'Not Connected' WHEN 1 THEN 'Call Not Picked' "
                    "WHEN 2 THEN 'Customer Busy' WHEN 3 THEN 'Interested' WHEN 4 THEN 'Call Later' "
                    "WHEN 5 THEN 'Not Interested' WHEN 6 THEN 'Booking Confirmed' "
                    "WHEN 7 THEN 'Package Sent' ELSE 'Other' END")
    return e.select(
        F.col("event_id").alias("conv_id"), F.col("event_id").alias("seq"),
        (F.col("event_id") % n_leads).alias("lead_pk"), (F.col("user_id") % n_users).alias("actor_id"),
        result.alias("call_result"), result.alias("summary"),
        F.when(F.col("event_type") == "click", "Incoming").otherwise("Outgoing").alias("call_type"),
        F.when(F.col("event_type") == "view",
               F.date_add(F.to_date("ts"), (F.col("event_id") % 7).cast("int"))).alias("next_followup_date"),
        F.col("ts").alias("created_at"),
        F.when(result == "Booking Confirmed", "Booked")
         .when(result == "Not Interested", "Lost").alias("status_update"))


def run_conversation_stream(spark: SparkSession, requests: DataFrame, leads: DataFrame, out_path: str,
                            checkpoint: str, as_of: str, timeout_s: float | None = None) -> None:
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        checkpoint_dir(batch.sparkSession)
        batch = batch.checkpoint(eager=True)      # the requests feed five outputs
        named = batch.select(F.col("lead_pk").alias("_b")).distinct()
        mine = leads.join(named, leads["id"] == named["_b"], "left_semi").select("id", "status").checkpoint(eager=True)
        res = apply_conversations(mine, batch, as_of)
        known = mine.select(F.col("id").alias("_l"))
        su = F.col("status_update")
        status = batch.where(su.isNotNull() & (su != "")).join(known, F.col("lead_pk") == F.col("_l"), "left_semi").select(
            F.col("lead_pk").alias("lead_id"), su.alias("status"), "created_at", "seq")
        for name, df in (("conversations", res["conversations"]), ("followups", res["followups"]),
                         ("activity_logs", res["audit"]), ("lead_status_changes", status), ("rejects", res["rejects"])):
            write_batch(df, out_path, name, batch_id)

    run_available_now(requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint), timeout_s)
    if not all(has_batches(spark, out_path, name) for name in OUTPUTS):
        per_batch(spark.createDataFrame([], requests.schema), NO_REQUESTS)      # no request came: outputs without rows


def read_output(spark: SparkSession, out_path: str, name: str) -> DataFrame:
    """One of ``OUTPUTS`` over all batches."""
    return read_batches(spark, out_path, name)


def current_status(leads: DataFrame, status_changes: DataFrame) -> DataFrame:
    """Lead status = latest change by request order, else the stored one."""
    last = (status_changes.groupBy(F.col("lead_id").alias("_l"))
            .agg(F.max_by("status", F.struct("seq", "status")).alias("_s")))
    j = leads.join(last, leads["id"] == last["_l"], "left")
    return j.select(*[F.coalesce("_s", "status").alias("status") if c == "status" else F.col(c)
                      for c in leads.columns])
