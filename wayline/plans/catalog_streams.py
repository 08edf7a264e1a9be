"""Registered streaming queries (T1, T2) and the batch twin of T1."""

from __future__ import annotations

from wayline.plans import params as P
from wayline.plans.registry import register
from wayline.session import scratch_path
from wayline.streaming import audit_counts as A
from wayline.streaming import change_stream as CS
from wayline.streaming.files import stream_table

_DAILY = """
SELECT date_trunc('day', created_at) AS window_start,
       date_trunc('day', created_at) + INTERVAL 1 DAY AS window_end,
       action, COUNT(*) AS cnt
FROM crm_activity_logs GROUP BY ALL"""


@register("activity_daily_counts", family="streams", oracle=_DAILY)
def activity_daily_counts(t):
    return A.batch_counts(t.activity_logs)


@register("activity_tumbling_counts", family="streams", oracle=_DAILY)
def activity_tumbling_counts(t):
    """The same counts, counted per micro-batch of a file stream and added up."""
    base = scratch_path(t.spark, "audit-stream")
    A.run_counts(A.audit_stream(t.spark, t.data_dir, P.STREAM_FILES_PER_BATCH), f"{base}/out", f"{base}/checkpoint")
    return A.final_counts(t.spark, f"{base}/out")


@register("stream_conversations", family="streams", oracle="""
SELECT c.id, c.lead_id, c.user_id, c.next_followup_date AS followup_date, c.call_result AS notes,
       'Pending' AS status, c.created_at
FROM crm_conversations c
WHERE c.next_followup_date IS NOT NULL AND c.lead_id IN (SELECT id FROM crm_leads)""")
def stream_conversations(t):
    """Conversation requests streamed through the M7 operator; returns the
    follow-ups committed by the micro-batches."""
    return CS.read_output(t.spark, run_conversations(t), "followups")


def run_conversations(t) -> str:
    """Run the conversation stream over the events; returns the folder of its outputs."""
    spark = t.spark
    base = scratch_path(spark, "conv-stream")
    # A backlog of files is taken a few files per micro-batch, so no batch is unbounded.
    events = stream_table(spark, f"{t.data_dir}/events.parquet", t.base("events").schema, P.STREAM_FILES_PER_BATCH)
    # Key ranges of the stand-in feed (the view mapping's modulus), from table metadata.
    n_leads, n_users = t.base("customer").count(), t.base("supplier").count()
    requests = CS.conversation_requests(events, n_leads, n_users)
    CS.run_conversation_stream(spark, requests, t.leads, f"{base}/out", f"{base}/checkpoint", P.ACTIVITY_AS_OF)
    return f"{base}/out"
