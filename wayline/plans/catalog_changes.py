"""Registered change-set queries.

Each query builds a change set from the CRM views (the stand-in for a batch
of incoming requests; the selection rules are those of FIXTURES D), runs the
generic operator on it and returns the resulting table state or summary.
The operators never see how the change set was chosen.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions.jsonpkg import parse
from wayline.operators import changes as M
from wayline.plans import catalog_nested as N
from wayline.plans import catalog_quality as Qc
from wayline.plans import params as P
from wayline.plans.registry import register
from wayline.session import scratch_path

AS_OF = P.AS_OF
ACT_AS_OF = P.ACTIVITY_AS_OF
N_USERS = "(SELECT count(*) FROM supplier)"
CATEGORY_DELETE_ID = 4


# -- change-set builders (stand-in request batches) ----------------------------------

def lead_update_changes(t):
    l = t.leads.where((F.col("id") % 10 == 0) | (F.col("id") % 10 == 1))
    return l.select(
        F.col("id").alias("lead_pk"), F.col("id").alias("seq"), F.lit(0).cast("bigint").alias("actor_id"),
        F.when(F.col("id") % 10 == 0, F.array(F.lit("status")))
         .otherwise(F.array(F.lit("alt_mobile"))).alias("fields"),
        F.when(F.col("id") % 10 == 0, F.lit("Lost")).alias("status"),
        F.lit(None).cast("string").alias("alt_mobile"))


def soft_delete_changes(t):
    """Admins trash every seventh lead, some of them twice with equal requests; staff ask in vain for others."""
    def ask(rows, later, role):
        return rows.select(F.col("id").alias("lead_pk"), (F.col("id") + later).alias("seq"),
                           F.lit(0).cast("bigint").alias("actor_id"), F.lit(role).alias("role"))
    l = t.leads
    return (ask(l.where(F.col("id") % 7 == 0), 0, "admin").union(ask(l.where(F.col("id") % 21 == 0), 0, "admin"))
            .union(ask(l.where(F.col("id") % 35 == 0), -1, "staff")))


def restore_changes(t):
    return t.leads.where((F.col("id") % 46 == 0) | (F.col("id") % 10 == 3)).select(
        F.col("id").alias("lead_pk"), F.col("id").alias("seq"), F.lit(0).cast("bigint").alias("actor_id"))


def hard_delete_changes(t):
    return t.leads.where(F.col("is_deleted") == 1).select(
        F.col("id").alias("lead_pk"), F.col("id").alias("seq"), F.lit(0).cast("bigint").alias("actor_id"),
        F.lit("admin").alias("role"))


def reassign_changes(t):
    l = t.leads.where(F.col("id") % 9 == 0)
    n_users = t.row_count("supplier")   # the mapping's user count, bound once
    return l.select(
        F.col("id").alias("lead_pk"), F.col("id").alias("seq"), F.lit(0).cast("bigint").alias("actor_id"),
        F.lit("admin").alias("role"),
        ((F.coalesce("assigned_to", F.lit(0)) + 1) % F.lit(n_users)).alias("new_assignee"),
        F.lit(None).cast("string").alias("notes"))


def conversation_changes(t):
    c = t.conversations
    return c.select(
        F.col("id").alias("conv_id"), F.col("id").alias("seq"), F.col("lead_id").alias("lead_pk"),
        F.col("user_id").alias("actor_id"), F.col("call_result").alias("summary"), "call_result",
        "call_type", "next_followup_date", "created_at",
        F.when(F.col("call_result") == "Booking Confirmed", "Booked")
         .when(F.col("call_result") == "Not Interested", "Lost").alias("status_update"))


def booking_changes(t):
    l = t.leads.where((F.col("status") == "Negotiation") | (F.col("id") % 50 == 0))
    total = (F.col("adults") * 10000 + F.col("children") * 5000).cast("decimal(10,2)")
    disc = F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.lit(0)).cast("decimal(10,2)")
    adv = F.when(F.col("id") % 2 == 0, F.lit(1000)).otherwise(F.lit(0)).cast("decimal(10,2)")
    return l.select(
        F.col("id").alias("lead_pk"), F.col("id").alias("seq"),
        F.coalesce("assigned_to", F.lit(0)).cast("bigint").alias("actor_id"),
        total.alias("total_amount"), disc.alias("discount"), (total - disc).alias("final_amount"),
        adv.alias("advance_paid"), (total - disc - adv).alias("balance"),
        F.lit("UPI").alias("payment_method"),
        F.when(F.col("id") % 4 == 0, F.col("enquiry_date").cast("string")).alias("payment_date"),
        F.lit(None).cast("string").alias("notes"))


def payment_split(t):
    early = t.payments.where(F.col("payment_date") < F.lit("1999-01-01").cast("date"))
    late = t.payments.where(F.col("payment_date") >= F.lit("1999-01-01").cast("date"))
    return early, late


def bookings_with_stored_balances(t, payments):
    paid = payments.groupBy(F.col("booking_id").alias("_b")).agg(F.sum("amount").alias("_p"))
    b = t.bookings.join(paid, F.col("id") == F.col("_b"), "left")
    p = F.coalesce(F.col("_p"), F.lit(0))
    return b.select(*t.bookings.columns, p.cast("decimal(18,2)").alias("advance_paid"),
                    (F.col("final_amount") - p).cast("decimal(18,2)").alias("balance"))


# -- registered queries --------------------------------------------------------------

_LEAD_COLS = ("id, lead_id, customer_name, mobile, city, tour_name, travel_date, adults, children, "
              "hotel_category, lead_source, assigned_to, enquiry_date, created_at, "
              "is_deleted, deleted_at, deleted_by, tour_category_id, tour_subcategory_id")


@register("apply_lead_updates", family="changes", oracle=f"""
SELECT {_LEAD_COLS},
  CASE WHEN id % 10 = 0 THEN 'Lost' ELSE status END AS status,
  CASE WHEN id % 10 = 1 THEN NULL ELSE alt_mobile END AS alt_mobile
FROM crm_leads""")
def apply_lead_updates(t):
    return M.apply_lead_updates(t.leads, lead_update_changes(t), AS_OF)["leads"]


@register("apply_soft_delete", family="changes", oracle=f"""
SELECT id,
  CASE WHEN id % 7 = 0 THEN 1 ELSE is_deleted END AS is_deleted,
  CASE WHEN id % 7 = 0 AND is_deleted = 0 THEN TIMESTAMP '{AS_OF}' ELSE deleted_at END AS deleted_at,
  CASE WHEN id % 7 = 0 AND is_deleted = 0 THEN 0 ELSE deleted_by END AS deleted_by
FROM crm_leads""")
def apply_soft_delete(t):
    return M.apply_soft_delete(t.leads, soft_delete_changes(t), AS_OF)["leads"].select(
        "id", "is_deleted", "deleted_at", "deleted_by")


@register("soft_delete_rejects", family="changes", oracle=f"""
SELECT id AS request_key, id AS seq, 'Not found' AS reason
FROM crm_leads WHERE id % 7 = 0 AND is_deleted = 1
UNION ALL SELECT id, id, 'Not found' FROM crm_leads WHERE id % 21 = 0
UNION ALL SELECT id, id - 1, '{M.MSG_DELETE_FORBIDDEN}' FROM crm_leads WHERE id % 35 = 0""")
def soft_delete_rejects(t):
    return M.apply_soft_delete(t.leads, soft_delete_changes(t), AS_OF)["rejects"]


@register("apply_restore", family="changes", oracle="""
SELECT id,
  CASE WHEN id % 46 = 0 OR id % 10 = 3 THEN 0 ELSE is_deleted END AS is_deleted,
  CASE WHEN id % 46 = 0 OR id % 10 = 3 THEN NULL ELSE deleted_at END AS deleted_at,
  CASE WHEN id % 46 = 0 OR id % 10 = 3 THEN NULL ELSE deleted_by END AS deleted_by
FROM crm_leads""")
def apply_restore(t):
    return M.apply_restore(t.leads, restore_changes(t), AS_OF)["leads"].select(
        "id", "is_deleted", "deleted_at", "deleted_by")


def _hard_delete_tables(t):
    return {"leads": t.leads, "followups": t.followups, "conversations": t.conversations,
            "packages": t.packages, "whatsapp_logs": t.whatsapp_logs, "lead_notes": t.lead_notes,
            "bookings": t.bookings, "payments": t.payments}


_GONE = "(SELECT id FROM crm_leads WHERE is_deleted = 1)"


def _before_after(name: str, table: str, key: str) -> str:
    return (f"SELECT '{name}' AS table_name, COUNT(*) AS rows_before, "
            f"COUNT(CASE WHEN {key} NOT IN {_GONE} OR {key} IS NULL THEN 1 END) AS rows_after FROM {table}")


@register("apply_hard_delete_counts", family="changes", oracle="\nUNION ALL\n".join([
    _before_after("followups", "crm_followups", "lead_id"),
    _before_after("conversations", "crm_conversations", "lead_id"),
    _before_after("packages", "crm_packages", "lead_id"),
    _before_after("whatsapp_logs", "crm_whatsapp_logs", "lead_id"),
    _before_after("lead_notes", "crm_lead_notes", "lead_id"),
    _before_after("bookings", "crm_bookings", "lead_id"),
    _before_after("leads", "crm_leads", "id"),
    "SELECT 'payments' AS table_name, COUNT(*) AS rows_before, COUNT(CASE WHEN booking_id NOT IN "
    f"(SELECT id FROM crm_bookings WHERE lead_id IN {_GONE}) THEN 1 END) AS rows_after FROM crm_payments",
]))
def apply_hard_delete_counts(t):
    tables = _hard_delete_tables(t)
    res = M.apply_hard_delete(tables, hard_delete_changes(t), AS_OF)
    return M.hard_delete_counts(tables, res["_gone"])


_REASSIGN = f"""
SELECT id AS lead_id, assigned_to AS assigned_from,
       (COALESCE(assigned_to, 0) + 1) % {N_USERS} AS assigned_to,
       CAST(0 AS BIGINT) AS assigned_by, '' AS notes, TIMESTAMP '{AS_OF}' AS created_at
FROM crm_leads WHERE id % 9 = 0"""


@register("apply_reassign", family="changes",
          oracle=f"SELECT * FROM ({_REASSIGN}) x WHERE assigned_to <> 0")
def apply_reassign(t):
    return M.apply_reassign(t.leads, reassign_changes(t), AS_OF)["lead_assignments"]


@register("reassign_rejects", family="changes", oracle=f"""
SELECT lead_id AS request_key, lead_id AS seq, 'assigned_to is required' AS reason
FROM ({_REASSIGN}) x WHERE assigned_to = 0""")
def reassign_rejects(t):
    return M.apply_reassign(t.leads, reassign_changes(t), AS_OF)["rejects"]


@register("conversation_to_followups", family="changes", oracle="""
SELECT (SELECT MAX(id) FROM crm_followups) + row_number() OVER (ORDER BY c.id) AS id, c.lead_id, c.user_id, c.next_followup_date AS followup_date, c.call_result AS notes,
       'Pending' AS status, c.created_at
FROM crm_conversations c
WHERE c.next_followup_date IS NOT NULL AND c.lead_id IN (SELECT id FROM crm_leads)""")
def conversation_to_followups(t):
    return M.apply_conversations(t.leads, conversation_changes(t), ACT_AS_OF, t.followups)["followups"]


@register("conversation_status_updates", family="changes", oracle="""
SELECT lead_id AS id, arg_max(st, id) AS status FROM (
  SELECT id, lead_id,
         CASE WHEN call_result = 'Booking Confirmed' THEN 'Booked'
              WHEN call_result = 'Not Interested' THEN 'Lost' END AS st
  FROM crm_conversations) x
WHERE st IS NOT NULL AND lead_id IN (SELECT id FROM crm_leads)
GROUP BY lead_id""")
def conversation_status_updates(t):
    res = M.apply_conversations(t.leads, conversation_changes(t), ACT_AS_OF)
    touched = res["lead_status"].select(F.col("_sl").alias("_t"))
    leads = res["leads"]
    return leads.join(touched, leads["id"] == touched["_t"], "left_semi").select("id", "status")


@register("apply_complete_followups", family="changes", oracle=f"""
SELECT id,
  CASE WHEN status = 'Pending' AND followup_date < DATE '{P.FOLLOWUP_AS_OF}' THEN 'Completed'
       ELSE status END AS status,
  CASE WHEN status = 'Pending' AND followup_date < DATE '{P.FOLLOWUP_AS_OF}'
       THEN TIMESTAMP '{ACT_AS_OF}' END AS completed_at
FROM crm_followups""")
def apply_complete_followups(t):
    f = t.followups
    due = f.where((F.col("status") == "Pending") &
                  (F.col("followup_date") < F.lit(P.FOLLOWUP_AS_OF).cast("date")))
    changes = due.select(F.col("id").alias("followup_id"))
    return M.apply_complete_followups(f, changes, ACT_AS_OF)["followups"].select(
        "id", "status", "completed_at")


_BOOK_REQ = f"""
req AS (SELECT id AS lead_pk, COALESCE(assigned_to, 0) AS actor_id,
          CAST(adults * 10000 + children * 5000 AS DECIMAL(10,2)) AS total_amount,
          CAST(CASE WHEN id % 3 = 0 THEN 500 ELSE 0 END AS DECIMAL(10,2)) AS discount,
          CAST(CASE WHEN id % 2 = 0 THEN 1000 ELSE 0 END AS DECIMAL(10,2)) AS advance_paid,
          CASE WHEN id % 4 = 0 THEN enquiry_date END AS pay_day
        FROM crm_leads WHERE status = 'Negotiation' OR id % 50 = 0),
acc AS (SELECT r.*, row_number() OVER (ORDER BY lead_pk) AS pos FROM req r
        WHERE lead_pk IN (SELECT id FROM crm_leads WHERE is_deleted = 0)
          AND lead_pk NOT IN (SELECT lead_id FROM crm_bookings)),
base AS (SELECT MAX(id) AS max_id,
                MAX(CASE WHEN regexp_matches(booking_id, '^BOOKING-[0-9]{{4}}-[0-9]{{5}}$')
                          AND split_part(booking_id, '-', 2) = '{AS_OF[:4]}'
                     THEN CAST(split_part(booking_id, '-', 3) AS BIGINT) END) AS max_seq
         FROM crm_bookings)"""


@register("apply_bookings", family="changes", oracle=f"""
WITH {_BOOK_REQ}
SELECT CAST(base.max_id + acc.pos AS BIGINT) AS id,
       printf('BOOKING-%d-%05d', {int(AS_OF[:4])}, COALESCE(base.max_seq, 0) + acc.pos) AS booking_id,
       acc.lead_pk AS lead_id, acc.actor_id AS user_id, acc.total_amount, acc.discount,
       CAST(acc.total_amount - acc.discount AS DECIMAL(10,2)) AS final_amount, acc.advance_paid,
       CAST(acc.total_amount - acc.discount - acc.advance_paid AS DECIMAL(10,2)) AS balance,
       'UPI' AS payment_method, COALESCE(acc.pay_day, DATE '{AS_OF[:10]}') AS payment_date,
       '' AS notes, TIMESTAMP '{AS_OF}' AS created_at
FROM acc, base""")
def apply_bookings(t):
    tables = {"leads": t.leads, "bookings": t.bookings}
    return M.apply_bookings(tables, booking_changes(t), AS_OF)["bookings_new"]


@register("booking_rejects", family="changes", oracle="""
SELECT l.id AS request_key, l.id AS seq,
  CASE WHEN l.is_deleted = 1 THEN 'Lead not found'
       ELSE 'Booking already exists for this lead: ' || b.code END AS reason
FROM crm_leads l
LEFT JOIN (SELECT lead_id, arg_min(booking_id, id) AS code FROM crm_bookings GROUP BY lead_id) b
  ON b.lead_id = l.id
WHERE (l.status = 'Negotiation' OR l.id % 50 = 0) AND (l.is_deleted = 1 OR b.lead_id IS NOT NULL)""")
def booking_rejects(t):
    tables = {"leads": t.leads, "bookings": t.bookings}
    return M.apply_bookings(tables, booking_changes(t), AS_OF)["rejects"]


@register("apply_payments", family="changes", oracle="""
SELECT b.id, CAST(COALESCE(p.paid, 0) AS DECIMAL(18,2)) AS advance_paid,
       CAST(b.final_amount - COALESCE(p.paid, 0) AS DECIMAL(18,2)) AS balance
FROM crm_bookings b
LEFT JOIN (SELECT booking_id, SUM(amount) AS paid FROM crm_payments GROUP BY booking_id) p
  ON p.booking_id = b.id""")
def apply_payments(t):
    # Read three times: written once, so that no task sorts the driver's tables once per use.
    stored = t.materialize(scratch_path(t.spark, "payments"), ["crm_payments"])
    early, late = payment_split(stored)
    start = bookings_with_stored_balances(t, early)
    changes = late.withColumn("actor_id", F.lit(0).cast("bigint")).withColumn("seq", F.lit(0))
    res = M.apply_payments(start, early, changes, AS_OF)
    return res["bookings"].select("id", "advance_paid", "balance")


@register("apply_user_deactivate", family="changes", oracle="""
SELECT id, username, full_name, role, CASE WHEN id % 5 = 2 THEN 0 ELSE is_active END AS is_active
FROM crm_users""")
def apply_user_deactivate(t):
    gone = t.users.where(F.col("id") % 5 == 2).select(F.col("id").alias("user_pk"))
    return M.apply_user_changes(t.users, deactivate=gone)["users"]


@register("whatsapp_per_lead", family="changes", oracle=r"""
SELECT lead_id, COUNT(*) AS messages FROM crm_whatsapp_logs
WHERE regexp_replace(COALESCE(message, ''), '^\s+|\s+$', '', 'g') <> ''
GROUP BY lead_id""")
def whatsapp_per_lead(t):
    w = t.whatsapp_logs
    changes = w.select(F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"),
                       "message", F.col("id").alias("seq"))
    rows = M.apply_whatsapp(changes, ACT_AS_OF)["whatsapp_logs_new"]
    return rows.groupBy("lead_id").agg(F.count(F.lit(1)).alias("messages"))


@register("notes_by_color", family="changes", oracle=r"""
SELECT color, COUNT(*) AS notes FROM (
  SELECT id, user_id, COALESCE(color, 'yellow') AS color FROM crm_lead_notes
  WHERE regexp_replace(COALESCE(note, ''), '^\s+|\s+$', '', 'g') <> '') n
WHERE NOT (n.id % 3 = 0 AND n.id % 2 = 0)
GROUP BY color""")
def notes_by_color(t):
    n = t.lead_notes
    adds = n.select("id", F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"),
                    "note", "color")
    # Staff ask to delete notes with id % 3 = 0: their own when id is even,
    # somebody else's otherwise (those are refused).
    deletes = n.where(F.col("id") % 3 == 0).select(
        F.col("id").alias("note_id"), F.col("id").alias("seq"), F.lit("staff").alias("role"),
        F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("actor_id"))
    kept = M.apply_notes(n.limit(0), adds, deletes)["lead_notes"]
    return kept.groupBy("color").agg(F.count(F.lit(1)).alias("notes"))


@register("leads_dangling_category", family="changes", oracle=f"""
SELECT id, lead_id, tour_category_id FROM crm_leads
WHERE tour_category_id IS NOT NULL
  AND tour_category_id NOT IN (SELECT id FROM crm_tour_categories WHERE id <> {CATEGORY_DELETE_ID})""")
def leads_dangling_category(t):
    deletes = t.tour_categories.where(F.col("id") == CATEGORY_DELETE_ID).select(
        F.col("id").alias("category_id"))
    res = M.apply_category_changes(t.tour_categories, t.tour_subcategories, None, deletes)
    return M.dangling_category_leads(t.leads, res["tour_categories"])


@register("category_delete_cascade", family="changes", oracle=f"""
SELECT category_id, COUNT(*) AS subcategories FROM crm_tour_subcategories
WHERE category_id <> {CATEGORY_DELETE_ID} GROUP BY category_id""")
def category_delete_cascade(t):
    deletes = t.tour_categories.where(F.col("id") == CATEGORY_DELETE_ID).select(
        F.col("id").alias("category_id"))
    res = M.apply_category_changes(t.tour_categories, t.tour_subcategories, None, deletes)
    return res["tour_subcategories"].groupBy("category_id").agg(F.count(F.lit(1)).alias("subcategories"))


def category_upserts(t):
    """Creates (some without a name, some by staff) and two replaces in a row of every second category."""
    c = t.tour_categories
    i = F.col("id")
    creates = c.select(F.lit(None).cast("bigint").alias("id"), i.alias("seq"), F.lit(0).cast("bigint").alias("actor_id"),
                       F.when(i % 3 == 0, "staff").otherwise("admin").alias("role"),
                       F.when(i % 4 == 1, "  ").otherwise(F.concat(F.lit("  New "), "name", F.lit(" "))).alias("name"))
    even = c.where(i % 2 == 0)
    replaces = [even.select("id", (i + 100 * n).alias("seq"), F.lit(0).cast("bigint").alias("actor_id"),
                            F.lit("manager").alias("role"), F.concat(F.lit(text), "name").alias("name"))
                for n, text in ((2, "Last "), (1, "First "))]
    return creates.unionByName(replaces[0]).unionByName(replaces[1])


def _category_changes(t):
    return M.apply_category_changes(t.tour_categories, t.tour_subcategories, category_upserts(t), None, AS_OF)


_MADE = """(SELECT *, row_number() OVER (ORDER BY id) AS pos FROM crm_tour_categories
  WHERE id % 3 <> 0 AND id % 4 <> 1)"""


@register("apply_category_upserts", family="changes", oracle=f"""
SELECT id, name, sort_order, is_active FROM crm_tour_categories WHERE id % 2 <> 0
UNION ALL SELECT id, 'Last ' || name, 0, 1 FROM crm_tour_categories WHERE id % 2 = 0
UNION ALL SELECT (SELECT MAX(id) FROM crm_tour_categories) + pos, 'New ' || name, 0, 1 FROM {_MADE} m""")
def apply_category_upserts(t):
    return _category_changes(t)["tour_categories"].select("id", "name", "sort_order", "is_active")


@register("category_upsert_rejects", family="changes", oracle=f"""
SELECT CAST(NULL AS BIGINT) AS request_key, id AS seq,
       CASE WHEN id % 3 = 0 THEN '{M.MSG_FORBIDDEN}' ELSE '{M.MSG_NAME}' END AS reason
FROM crm_tour_categories WHERE id % 3 = 0 OR id % 4 = 1""")
def category_upsert_rejects(t):
    return _category_changes(t)["rejects"]


@register("category_upsert_audit", family="changes", oracle=f"""
SELECT CAST(0 AS BIGINT) AS user_id, 'CREATE_TOUR_CATEGORY' AS action,
       'Created tour category: New ' || name AS details, TIMESTAMP '{AS_OF}' AS created_at FROM {_MADE} m""")
def category_upsert_audit(t):
    return _category_changes(t)["audit"].select("user_id", "action", "details", "created_at")


@register("apply_subcategories", family="changes", oracle="""
SELECT id, category_id, CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END AS name,
       duration_days, duration_nights, starting_price, tags, sort_order, is_active
FROM crm_tour_subcategories WHERE id % 5 <> 0""")
def apply_subcategories(t):
    s = t.tour_subcategories
    upserts = s.where(F.col("id") % 2 == 0).withColumn("name", F.upper("name")).withColumn(
        "seq", F.col("id"))
    deletes = s.where(F.col("id") % 5 == 0).select("id")
    return M.apply_subcategory_changes(s, upserts, deletes)["tour_subcategories"]


_ENCODED = ", ".join(f"{N.json_text_sql(m, a)} AS {m}" for m, a in
                     (("itinerary", "it"), ("hotels", "h"), ("transport", "tr"),
                      ("other_charges", "oc")))
_MONEY = ("CAST(COALESCE(c.base_price, 0) AS DECIMAL(10,2)) AS base_price, "
          "CAST(COALESCE(c.discount, 0) AS DECIMAL(10,2)) AS discount, "
          "CAST(COALESCE(c.base_price - c.discount, 0) AS DECIMAL(10,2)) AS final_price, '' AS notes")


@register("apply_packages", family="changes", oracle=f"""
WITH {N._PARSED}
SELECT id, lead_id, user_id, tour_name, itinerary, hotels, transport, other_charges,
       base_price, discount, CAST(NULL AS DECIMAL(10,2)) AS final_price,
       CAST(NULL AS VARCHAR) AS notes
FROM crm_packages WHERE id % 5 <> 0
UNION ALL
SELECT c.id, c.lead_id, c.user_id, COALESCE(upper(c.tour_name), '') AS tour_name, {_ENCODED}, {_MONEY}
FROM crm_packages c JOIN p ON c.id = p.id WHERE c.id % 5 = 0
UNION ALL
SELECT COALESCE((SELECT MAX(id) FROM crm_packages), 0) + row_number() OVER (ORDER BY c.id) AS id,
       c.lead_id, c.user_id, COALESCE(c.tour_name, '') AS tour_name, {_ENCODED}, {_MONEY}
FROM crm_packages c JOIN p ON c.id = p.id WHERE c.id % 7 = 0""")
def apply_packages(t):
    p = t.packages
    members = [parse(c).alias(c) for c in ("itinerary", "hotels", "transport", "other_charges")]
    updates = p.where(F.col("id") % 5 == 0).select(
        F.lit("update").alias("op"), F.col("id").alias("package_id"), F.col("id").alias("seq"),
        F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"),
        F.upper("tour_name").alias("tour_name"), *members, "base_price", "discount",
        (F.col("base_price") - F.col("discount")).alias("final_price"))
    creates = p.where(F.col("id") % 7 == 0).select(
        F.lit("create").alias("op"), F.lit(None).cast("bigint").alias("package_id"),
        F.col("id").alias("seq"), F.col("lead_id").alias("lead_pk"),
        F.col("user_id").alias("actor_id"), "tour_name", *members, "base_price", "discount",
        (F.col("base_price") - F.col("discount")).alias("final_price"))
    return M.apply_packages(p, updates.unionByName(creates), AS_OF)["packages"]


@register("audit_rows_from_changes", family="changes", oracle=f"""
SELECT action, COUNT(*) AS cnt FROM (
  SELECT 'UPDATE_LEAD' AS action FROM crm_leads WHERE id % 10 IN (0, 1)
  UNION ALL SELECT 'SOFT_DELETE_LEAD' FROM crm_leads WHERE id % 7 = 0 AND is_deleted = 0
  UNION ALL SELECT 'RESTORE_LEAD' FROM crm_leads WHERE (id % 46 = 0 OR id % 10 = 3) AND is_deleted = 1
  UNION ALL SELECT 'REASSIGN_LEAD' FROM ({_REASSIGN}) r WHERE r.assigned_to <> 0
  UNION ALL SELECT 'ADD_CONVERSATION' FROM crm_conversations WHERE lead_id IN (SELECT id FROM crm_leads)
  UNION ALL SELECT 'WHATSAPP_LOG' FROM crm_whatsapp_logs
    WHERE regexp_replace(COALESCE(message, ''), '^\\s+|\\s+$', '', 'g') <> ''
) x GROUP BY action""")
def audit_rows_from_changes(t):
    w = t.whatsapp_logs.select(F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"),
                               "message", F.col("id").alias("seq"))
    audits = M.audit_union(
        M.apply_lead_updates(t.leads, lead_update_changes(t), AS_OF)["audit"],
        M.apply_soft_delete(t.leads, soft_delete_changes(t), AS_OF)["audit"],
        M.apply_restore(t.leads, restore_changes(t), AS_OF)["audit"],
        M.apply_reassign(t.leads, reassign_changes(t), AS_OF)["audit"],
        M.apply_conversations(t.leads, conversation_changes(t), ACT_AS_OF)["audit"],
        M.apply_whatsapp(w, ACT_AS_OF)["audit"])
    return audits.groupBy("action").agg(F.count(F.lit(1)).alias("cnt"))


@register("apply_create_leads", family="changes", oracle=f"""
WITH {Qc.REQ_REASON},
good AS ({Qc.GOOD_SQL}),
g AS (SELECT *, row_number() OVER (ORDER BY request_id) AS rn FROM good),
b AS (SELECT MAX(id) AS max_id,
             (SELECT TRY_CAST(split_part(arg_max(lead_id, id), '-', 3) AS BIGINT) FROM crm_leads
              WHERE lead_id LIKE 'LEAD-{AS_OF[:4]}-%') AS last_seq
      FROM crm_leads)
SELECT CAST(b.max_id + g.rn AS BIGINT) AS id,
       printf('LEAD-%d-%05d', {int(AS_OF[:4])}, COALESCE(b.last_seq, 0) + g.rn) AS lead_id,
       customer_name, mobile, alt_mobile, email, city, tour_name, travel_date, pickup_location, drop_location,
       adults, children, hotel_category, meal_plan, vehicle_type, lead_source, assigned_to, status, enquiry_date,
       notes, TIMESTAMP '{AS_OF}' AS created_at, 0 AS is_deleted, request_id
FROM g, b""")
def apply_create_leads(t):
    """M1: the intake batch (all lead requests) inserted as new leads."""
    return M.apply_create_leads(t.leads, t.users, t.lead_requests, AS_OF)["leads_new"]


def _user_changes(t):
    """Creates by admins and managers (managers in vain), with and without a role."""
    u, i = t.users, F.col("id")
    creates = u.select(i.alias("seq"), F.lit(0).cast("bigint").alias("actor_id"),
                       F.when(i % 4 == 0, "manager").otherwise("admin").alias("role_of_actor"),
                       F.concat(F.lit("new_"), "username").alias("username"), "full_name",
                       F.when(i % 3 == 0, "manager").alias("role"))
    return M.apply_user_changes(u, creates=creates, as_of=AS_OF)


_NEW_USERS = "(SELECT *, row_number() OVER (ORDER BY id) AS pos FROM crm_users WHERE id % 4 <> 0) n"


@register("apply_user_creates", family="changes", oracle=f"""
SELECT id, username, full_name, role, is_active FROM crm_users
UNION ALL SELECT (SELECT MAX(id) FROM crm_users) + pos, 'new_' || username, full_name,
  CASE WHEN id % 3 = 0 THEN 'manager' ELSE 'staff' END, 1 FROM {_NEW_USERS}""")
def apply_user_creates(t):
    return _user_changes(t)["users"].select("id", "username", "full_name", "role", "is_active")


@register("user_create_rejects", family="changes", oracle=f"""
SELECT CAST(NULL AS BIGINT) AS request_key, id AS seq, '{M.MSG_FORBIDDEN}' AS reason FROM crm_users WHERE id % 4 = 0""")
def user_create_rejects(t):
    return _user_changes(t)["rejects"]


@register("user_create_audit", family="changes", oracle=f"""
SELECT CAST(0 AS BIGINT) AS user_id, 'CREATE_USER' AS action, 'Created user new_' || username AS details,
       TIMESTAMP '{AS_OF}' AS created_at FROM {_NEW_USERS}""")
def user_create_audit(t):
    return _user_changes(t)["audit"].select("user_id", "action", "details", "created_at")


# -- post-states and audit texts ------------------------------------------------------

@register("reassigned_leads", family="changes", oracle=f"""
SELECT l.id, CASE WHEN r.assigned_to <> 0 THEN r.assigned_to ELSE l.assigned_to END AS assigned_to
FROM crm_leads l LEFT JOIN ({_REASSIGN}) r ON r.lead_id = l.id""")
def reassigned_leads(t):
    return M.apply_reassign(t.leads, reassign_changes(t), AS_OF)["leads"].select("id", "assigned_to")


def _booked(t):
    return M.apply_bookings({"leads": t.leads, "bookings": t.bookings}, booking_changes(t), AS_OF)


@register("booking_advance_payments", family="changes", oracle=f"""
WITH {_BOOK_REQ}
SELECT CAST(base.max_id + acc.pos AS BIGINT) AS booking_id, acc.advance_paid AS amount, 'UPI' AS payment_method,
       COALESCE(acc.pay_day, DATE '{AS_OF[:10]}') AS payment_date, 'Advance payment' AS notes
FROM acc, base WHERE acc.advance_paid > 0""")
def booking_advance_payments(t):
    return _booked(t)["payments_new"]


@register("booked_leads", family="changes", oracle=f"""
WITH {_BOOK_REQ}
SELECT id, CASE WHEN id IN (SELECT lead_pk FROM acc) THEN 'Booked' ELSE status END AS status FROM crm_leads""")
def booked_leads(t):
    return _booked(t)["leads"].select("id", "status")


@register("whatsapp_rows", family="changes", oracle=rf"""
SELECT lead_id, user_id, regexp_replace(message, '^\s+|\s+$', '', 'g') AS message, TIMESTAMP '{ACT_AS_OF}' AS created_at
FROM crm_whatsapp_logs WHERE regexp_replace(COALESCE(message, ''), '^\s+|\s+$', '', 'g') <> ''""")
def whatsapp_rows(t):
    w = t.whatsapp_logs
    changes = w.select(F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"), "message",
                       F.col("id").alias("seq"))
    return M.apply_whatsapp(changes, ACT_AS_OF)["whatsapp_logs_new"].select("lead_id", "user_id", "message", "created_at")


def _hard_delete(t):
    return M.apply_hard_delete(_hard_delete_tables(t), hard_delete_changes(t), AS_OF)


@register("hard_delete_followups", family="changes", oracle=f"""
SELECT id, lead_id, status FROM crm_followups WHERE lead_id NOT IN {_GONE}""")
def hard_delete_followups(t):
    return _hard_delete(t)["followups"].select("id", "lead_id", "status")


@register("hard_delete_payments", family="changes", oracle=f"""
SELECT booking_id, amount, payment_date FROM crm_payments
WHERE booking_id NOT IN (SELECT id FROM crm_bookings WHERE lead_id IN {_GONE})""")
def hard_delete_payments(t):
    return _hard_delete(t)["payments"].select("booking_id", "amount", "payment_date")


@register("category_delete_rows", family="changes", oracle=f"""
SELECT id, category_id, name FROM crm_tour_subcategories WHERE category_id <> {CATEGORY_DELETE_ID}""")
def category_delete_rows(t):
    deletes = t.tour_categories.where(F.col("id") == CATEGORY_DELETE_ID).select(F.col("id").alias("category_id"))
    res = M.apply_category_changes(t.tour_categories, t.tour_subcategories, None, deletes)
    return res["tour_subcategories"].select("id", "category_id", "name")


@register("audit_texts", family="changes", oracle=f"""
SELECT 'UPDATE_LEAD' AS action, id AS entity_id, 'Updated lead ' || id AS details FROM crm_leads WHERE id % 10 IN (0, 1)
UNION ALL SELECT 'SOFT_DELETE_LEAD', id, 'Soft-deleted lead ' || lead_id FROM crm_leads WHERE id % 7 = 0 AND is_deleted = 0
UNION ALL SELECT 'RESTORE_LEAD', id, 'Restored lead ' || lead_id
  FROM crm_leads WHERE (id % 46 = 0 OR id % 10 = 3) AND is_deleted = 1
UNION ALL SELECT 'ADD_CONVERSATION', lead_id, 'Added conversation to lead ' || lead_id
  FROM crm_conversations WHERE lead_id IN (SELECT id FROM crm_leads)
UNION ALL (WITH {_BOOK_REQ} SELECT 'CREATE_BOOKING', CAST(base.max_id + acc.pos AS BIGINT),
  'Created booking ' || printf('BOOKING-%d-%05d', {int(AS_OF[:4])}, COALESCE(base.max_seq, 0) + acc.pos)
  || ' for lead ' || acc.lead_pk FROM acc, base)""")
def audit_texts(t):
    return M.audit_union(
        M.apply_lead_updates(t.leads, lead_update_changes(t), AS_OF)["audit"],
        M.apply_soft_delete(t.leads, soft_delete_changes(t), AS_OF)["audit"],
        M.apply_restore(t.leads, restore_changes(t), AS_OF)["audit"],
        M.apply_conversations(t.leads, conversation_changes(t), ACT_AS_OF)["audit"],
        _booked(t)["audit"]).select("action", "entity_id", "details")
