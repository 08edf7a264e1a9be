"""Registered change-set queries on awkward batches: missing roles and order keys, ties, repeats, unknown ids.

Each batch is a stand-in derived from the views, as in ``catalog_changes``; the oracles state the fate of every request.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions.jsonpkg import parse
from wayline.operators import changes as M
from wayline.plans import catalog_changes as Ch
from wayline.plans import params as P
from wayline.plans import catalog_quality as Qc
from wayline.plans.catalog_streams import run_conversations
from wayline.plans.registry import register
from wayline.streaming import change_stream as CS

AS_OF, ACT_AS_OF = P.AS_OF, P.ACTIVITY_AS_OF
LATER = 10**10           # added to the seq of a second request


def _fates(res) -> "DataFrame":  # noqa: F821
    """Every request of a batch with what became of it."""
    return res["applied"].withColumn("reason", F.lit("applied")).unionByName(res["rejects"])


# -- M5: roles missing, requests repeated, leads not in the trash -------------------------

def _hard_deletes(t):
    l, i = t.leads, F.col("id")
    role = F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, "staff").otherwise("admin")
    first = l.where(i % 23 < 2).select(i.alias("lead_pk"), F.when(i % 3 != 0, i).alias("seq"),
                                       F.lit(0).cast("bigint").alias("actor_id"), role.alias("role"))
    again = l.where(i % 46 == 0).select(i.alias("lead_pk"), (i + LATER).alias("seq"),
                                        F.lit(0).cast("bigint").alias("actor_id"), F.lit("admin").alias("role"))
    return M.apply_hard_delete({"leads": l, "bookings": t.bookings, "payments": t.payments}, first.unionByName(again), AS_OF)


_HARD = f"""
ask AS (SELECT id, CASE WHEN id % 3 <> 0 THEN id END AS seq, id % 5 <> 0 AND id % 7 <> 0 AS may, is_deleted
  FROM crm_leads WHERE id % 23 < 2
  UNION ALL SELECT id, id + {LATER}, TRUE, is_deleted FROM crm_leads WHERE id % 46 = 0),
fate AS (SELECT *, row_number() OVER (PARTITION BY id, may ORDER BY seq NULLS FIRST) AS k FROM ask)"""


@register("hard_delete_fates", family="requests", oracle=f"""
WITH {_HARD} SELECT id AS request_key, seq, CASE WHEN NOT may THEN '{M.MSG_FORBIDDEN}'
  WHEN is_deleted = 1 AND k = 1 THEN 'applied' ELSE 'Not found in trash' END AS reason FROM fate""")
def hard_delete_fates(t):
    return _fates(_hard_deletes(t))


@register("hard_delete_leads", family="requests", oracle=f"""
WITH {_HARD} SELECT id, lead_id FROM crm_leads WHERE id NOT IN (SELECT id FROM fate WHERE may AND is_deleted = 1)""")
def hard_delete_leads(t):
    return _hard_deletes(t)["leads"].select("id", "lead_id")


# -- M6: roles missing, chains of requests, the first without seq ----------------------------

def _reassigns(t):
    """Up to three requests a lead: without seq to 3, then to 5 and (again without a known role) to 7."""
    l, i = t.leads, F.col("id")

    def ask(rows, seq, role, to):
        return rows.select(i.alias("lead_pk"), seq.cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("actor_id"),
                           F.lit(role).cast("string").alias("role"), F.lit(to).cast("bigint").alias("new_assignee"),
                           F.lit(None).cast("string").alias("notes"))

    batch = (ask(l.where(i % 9 == 0), F.lit(None), "manager", 3).unionByName(ask(l.where(i % 18 == 0), i, "admin", 5))
             .unionByName(ask(l.where(i % 27 == 0), i + LATER, None, 7)).unionByName(ask(l.where(i % 36 == 0), i, "admin", None))
             .unionByName(ask(l.where(i % 45 == 0).withColumn("id", -i - 1), F.lit(1), "admin", 5)))
    return M.apply_reassign(l, batch, AS_OF)


@register("reassign_chain", family="requests", oracle=f"""
SELECT id AS lead_id, assigned_to AS assigned_from, CAST(3 AS BIGINT) AS assigned_to FROM crm_leads WHERE id % 9 = 0
UNION ALL SELECT id, 3, 5 FROM crm_leads WHERE id % 18 = 0""")
def reassign_chain(t):
    return _reassigns(t)["lead_assignments"].select("lead_id", "assigned_from", "assigned_to")


@register("reassign_fates", family="requests", oracle=f"""
SELECT id AS request_key, CAST(NULL AS BIGINT) AS seq, 'applied' AS reason FROM crm_leads WHERE id % 9 = 0
UNION ALL SELECT id, id, 'applied' FROM crm_leads WHERE id % 18 = 0
UNION ALL SELECT id, id + {LATER}, '{M.MSG_FORBIDDEN}' FROM crm_leads WHERE id % 27 = 0
UNION ALL SELECT id, id, 'assigned_to is required' FROM crm_leads WHERE id % 36 = 0
UNION ALL SELECT -id - 1, 1, 'Lead not found' FROM crm_leads WHERE id % 45 = 0""")
def reassign_fates(t):
    return _fates(_reassigns(t))


# -- M9: updates that tie, unknown packages, unknown operations ---------------------------------

def _package_batch(t):
    p, i = t.packages, F.col("id")
    members = [parse(c).alias(c) for c in ("itinerary", "hotels", "transport", "other_charges")]

    def ask(rows, op, package, seq, name):
        return rows.select(F.lit(op).alias("op"), package.cast("bigint").alias("package_id"), seq.cast("bigint").alias("seq"),
                           F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"), F.lit(name).alias("tour_name"),
                           *members, "base_price", "discount", F.col("base_price").alias("final_price"))

    five = p.where(i % 5 == 0)
    # Three updates tie on seq (two of them equal), and one before them names another tour.
    return (ask(five, "update", i, F.lit(7), "same").unionByName(ask(five, "update", i, F.lit(7), "same"))
            .unionByName(ask(five, "update", i, F.lit(None), "early")).unionByName(ask(five, "update", -i - 1, i, "none"))
            .unionByName(ask(p.where(i % 10 == 1), "create", F.lit(None), F.lit(None), "new"))
            .unionByName(ask(p.where(i % 10 == 2), None, i, i, "odd")))


@register("package_names_after_changes", family="requests", oracle="""
SELECT id, CASE WHEN id % 5 = 0 THEN 'same' ELSE tour_name END AS tour_name FROM crm_packages
UNION ALL SELECT (SELECT MAX(id) FROM crm_packages) + row_number() OVER (), 'new' FROM crm_packages WHERE id % 10 = 1""")
def package_names_after_changes(t):
    return M.apply_packages(t.packages, _package_batch(t), AS_OF)["packages"].select("id", "tour_name")


@register("package_fates", family="requests", oracle="""
SELECT id AS request_key, CAST(7 AS BIGINT) AS seq, 'applied' AS reason FROM crm_packages, range(2) WHERE id % 5 = 0
UNION ALL SELECT id, NULL, 'applied' FROM crm_packages WHERE id % 5 = 0
UNION ALL SELECT -id - 1, id, 'Not found' FROM crm_packages WHERE id % 5 = 0
UNION ALL SELECT NULL, NULL, 'applied' FROM crm_packages WHERE id % 10 = 1
UNION ALL SELECT id, id, 'Unknown operation' FROM crm_packages WHERE id % 10 = 2""")
def package_fates(t):
    return _fates(M.apply_packages(t.packages, _package_batch(t), AS_OF))


# -- M10: requests without seq, twice for a lead ---------------------------------------------------

def _odd_bookings(t):
    first = Ch.booking_changes(t).withColumn("seq", F.when(F.col("lead_pk") % 4 != 0, F.col("lead_pk")))
    again = first.where(F.col("lead_pk") % 6 == 0).withColumn("seq", F.col("lead_pk") + LATER)
    return M.apply_bookings({"leads": t.leads, "bookings": t.bookings}, first.unionByName(again), AS_OF)


@register("booking_fates", family="requests", oracle=f"""
WITH r AS (SELECT l.id, l.is_deleted, b.lead_id IS NOT NULL AS booked FROM crm_leads l
  LEFT JOIN (SELECT DISTINCT lead_id FROM crm_bookings) b ON b.lead_id = l.id WHERE l.status = 'Negotiation' OR l.id % 50 = 0)
SELECT id AS request_key, CASE WHEN id % 4 <> 0 THEN id END AS seq, CASE WHEN is_deleted = 1 THEN 'Lead not found'
  WHEN booked THEN 'exists' ELSE 'applied' END AS reason FROM r
UNION ALL SELECT id, id + {LATER}, CASE WHEN is_deleted = 1 THEN 'Lead not found' ELSE 'exists' END FROM r WHERE id % 6 = 0""")
def booking_fates(t):
    rows = _fates(_odd_bookings(t))
    return rows.withColumn("reason", F.when(F.col("reason").startswith("Booking already exists"), "exists").otherwise(F.col("reason")))


# -- M16: partial updates of users -------------------------------------------------------------------

def _user_updates(t):
    """Two partial updates a user (the second wins where both set a field), some by managers, some of unknown users."""
    u, i = t.users, F.col("id")

    def ask(rows, seq, fields, name, role, key=i):
        return rows.select(key.alias("user_pk"), seq.cast("bigint").alias("seq"), F.array(*map(F.lit, fields)).alias("fields"),
                           F.lit(name).cast("string").alias("full_name"), F.lit(role).cast("string").alias("role"),
                           F.when(i % 4 == 0, "manager").otherwise("admin").alias("role_of_actor"))

    even = u.where(i % 2 == 0)
    batch = (ask(even, F.lit(None), ["full_name", "role"], "First", "manager").unionByName(ask(even, i, ["full_name"], None, None))
             .unionByName(ask(u.where(i % 3 == 0), i + LATER, ["role"], "unused", "staff"))
             .unionByName(ask(u.where(i % 7 == 0), i, ["role"], None, "admin", -i - 1)))
    return M.apply_user_changes(u, updates=batch, as_of=AS_OF)


@register("apply_user_updates", family="requests", oracle="""
SELECT id, username, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN NULL ELSE full_name END AS full_name,
  CASE WHEN id % 4 = 0 THEN role WHEN id % 3 = 0 THEN 'staff' WHEN id % 2 = 0 THEN 'manager' ELSE role END AS role, is_active
FROM crm_users""")
def apply_user_updates(t):
    return _user_updates(t)["users"].select("id", "username", "full_name", "role", "is_active")


@register("user_update_rejects", family="requests", oracle=f"""
SELECT id AS request_key, CAST(NULL AS BIGINT) AS seq, '{M.MSG_FORBIDDEN}' AS reason FROM crm_users WHERE id % 4 = 0
UNION ALL SELECT id, id, '{M.MSG_FORBIDDEN}' FROM crm_users WHERE id % 4 = 0
UNION ALL SELECT id, id + {LATER}, '{M.MSG_FORBIDDEN}' FROM crm_users WHERE id % 4 = 0 AND id % 3 = 0
UNION ALL SELECT -id - 1, id, CASE WHEN id % 4 = 0 THEN '{M.MSG_FORBIDDEN}' ELSE 'Not found' END FROM crm_users WHERE id % 7 = 0""")
def user_update_rejects(t):
    return _user_updates(t)["rejects"]


# -- M17: audit texts of the other actions ---------------------------------------------------------------

_GOOD_LEADS = f"""
WITH {Qc.REQ_REASON},
good AS ({Qc.GOOD_SQL}),
g AS (SELECT *, row_number() OVER (ORDER BY request_id) AS rn FROM good),
b AS (SELECT MAX(id) AS max_id, (SELECT TRY_CAST(split_part(arg_max(lead_id, id), '-', 3) AS BIGINT) FROM crm_leads
  WHERE lead_id LIKE 'LEAD-{AS_OF[:4]}-%') AS last_seq FROM crm_leads)
SELECT 'CREATE_LEAD', CAST(b.max_id + g.rn AS BIGINT),
  'Created lead ' || printf('LEAD-%d-%05d', {int(AS_OF[:4])}, COALESCE(b.last_seq, 0) + g.rn) FROM g, b"""


@register("audit_texts_more", family="requests", oracle=f"""
SELECT 'REASSIGN_LEAD' AS action, lead_id AS entity_id, 'Reassigned lead ' || lead_id || ' from user '
  || COALESCE(CAST(assigned_from AS VARCHAR), 'None') || ' to ' || assigned_to AS details
FROM ({Ch._REASSIGN}) x WHERE assigned_to <> 0
UNION ALL SELECT 'WHATSAPP_LOG', lead_id, 'WhatsApp logged for lead ' || lead_id FROM crm_whatsapp_logs
  WHERE regexp_replace(COALESCE(message, ''), '^\\s+|\\s+$', '', 'g') <> ''
UNION ALL SELECT 'PERMANENT_DELETE_LEAD', id, 'Permanently deleted lead ' || lead_id FROM crm_leads WHERE is_deleted = 1
UNION ALL SELECT 'ADD_PAYMENT', p.booking_id, 'Payment ₹' || p.amount || ' added to booking ' || p.booking_id
  FROM crm_payments p JOIN crm_bookings b ON b.id = p.booking_id WHERE p.payment_date >= DATE '1999-01-01'
UNION ALL ({_GOOD_LEADS})""")
def audit_texts_more(t):
    w = t.whatsapp_logs.select(F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"), "message",
                               F.col("id").alias("seq"))
    early, late = Ch.payment_split(t)
    pays = late.withColumn("actor_id", F.lit(0).cast("bigint")).withColumn("seq", F.lit(0))
    return M.audit_union(
        M.apply_reassign(t.leads, Ch.reassign_changes(t), AS_OF)["audit"],
        M.apply_whatsapp(w, ACT_AS_OF)["audit"],
        M.apply_hard_delete({"leads": t.leads, "bookings": t.bookings, "payments": t.payments},
                            Ch.hard_delete_changes(t), AS_OF)["audit"],
        M.apply_payments(Ch.bookings_with_stored_balances(t, early), early, pays, AS_OF)["audit"],
        M.apply_create_leads(t.leads, t.users, t.lead_requests, AS_OF)["audit"]).select("action", "entity_id", "details")


# -- T2: the other outputs of the conversation stream ------------------------------------------------------

_STREAMED = """(SELECT id, lead_id, user_id, created_at, call_result, CASE WHEN call_result = 'Booking Confirmed' THEN 'Booked'
  WHEN call_result = 'Not Interested' THEN 'Lost' END AS st FROM crm_conversations) c"""


@register("stream_lead_status", family="requests", oracle=f"""
SELECT l.id, COALESCE(s.st, l.status) AS status FROM crm_leads l LEFT JOIN (
  SELECT lead_id, arg_max(st, id) AS st FROM {_STREAMED} WHERE st IS NOT NULL GROUP BY lead_id) s ON s.lead_id = l.id""")
def stream_lead_status(t):
    changes = CS.read_output(t.spark, run_conversations(t), "lead_status_changes")
    return CS.current_status(t.leads, changes).select("id", "status")


@register("stream_fates", family="requests", oracle=f"""
SELECT 'audit' AS output, lead_id AS request_key, 'Added conversation to lead ' || lead_id AS detail FROM {_STREAMED}
WHERE lead_id IN (SELECT id FROM crm_leads)
UNION ALL SELECT 'reject', lead_id, id || ' Lead not found' FROM {_STREAMED} WHERE lead_id NOT IN (SELECT id FROM crm_leads)
UNION ALL SELECT 'conversation', lead_id, id || ' ' || call_result FROM {_STREAMED} WHERE lead_id IN (SELECT id FROM crm_leads)""")
def stream_fates(t):
    out = run_conversations(t)
    read = lambda name: CS.read_output(t.spark, out, name)
    return (read("activity_logs").select(F.lit("audit").alias("output"), F.col("entity_id").alias("request_key"),
                                         F.col("details").alias("detail"))
            .unionByName(read("rejects").select(F.lit("reject").alias("output"), "request_key",
                                                F.concat_ws(" ", "seq", "reason").alias("detail")))
            .unionByName(read("conversations").select(F.lit("conversation").alias("output"), F.col("lead_id").alias("request_key"),
                                                      F.concat_ws(" ", "id", "call_result").alias("detail"))))
