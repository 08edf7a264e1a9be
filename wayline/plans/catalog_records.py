"""Registered queries on stored records: JSON members, reconciliation, duplicate check, appends, notes, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import changes as M
from wayline.operators import exports as X
from wayline.operators import lists as L
from wayline.operators import packages as PK
from wayline.operators import quality as Q
from wayline.operators import reports as R
from wayline.plans import catalog_changes as Ch
from wayline.plans import catalog_lists as Li
from wayline.plans import catalog_reports as Re
from wayline.plans import params as P
from wayline.plans.registry import register
from wayline.session import scratch_path
from wayline.sources import io

AS_OF = P.AS_OF


# -- X24: JSON members, decoded or raw ---------------------------------------------

def _member(name: str, shape: str) -> str:
    """A member's oracle rows; ``shape`` lists keys in sorted order, as the decoded text has them."""
    kind = "array" if shape.startswith("[") else "object"
    good = f"{name} <> '' AND json_valid({name})"
    return f"""
SELECT id, '{name}' AS member, {name} AS t, {good} AS ok,
  CASE WHEN {good} THEN CASE json_type({name}) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object'
    WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind,
  CASE WHEN {good} THEN CASE WHEN json_type({name}) = '{kind.upper()}'
    THEN CAST(to_json(from_json({name}, '{shape}')) AS VARCHAR) ELSE CAST(json({name}) AS VARCHAR) END END AS value
FROM crm_package_drafts"""


@register("package_members", family="records", oracle=f"""
SELECT id, member, kind, value, CASE WHEN ok IS NOT TRUE THEN t END AS raw_text,
       t IS NOT NULL AND t <> '' AND NOT ok AS failed
FROM ({" UNION ALL ".join([
    _member("itinerary", '[{"day":"BIGINT","description":"VARCHAR"}]'),
    _member("hotels", '[{"city":"VARCHAR","price":"BIGINT"}]'),
    _member("transport", '{"price":"BIGINT","type":"VARCHAR"}'),
    _member("other_charges", '[{"amount":"BIGINT","name":"VARCHAR"}]')])}) m""")
def package_members(t):
    return PK.package_members(t.package_drafts)


# -- V4, S4: stored amounts -----------------------------------------------------------

@register("booking_reconciliation", family="records", oracle="""
WITH p AS (SELECT booking_id, CAST(SUM(amount) AS DECIMAL(18,2)) AS s FROM crm_payments GROUP BY booking_id),
j AS (SELECT b.*, booking_id AS pb, CAST(COALESCE(s, 0) AS DECIMAL(18,2)) AS paid
      FROM (SELECT id, total_amount, discount, final_amount, advance_paid, balance FROM crm_stored_bookings) b
      FULL JOIN p ON booking_id = id),
i AS (SELECT COALESCE(id, pb) AS booking_pk, advance_paid, balance, paid, CAST(final_amount - paid AS DECIMAL(18,2)) AS due,
  concat_ws(',', CASE WHEN final_amount <> total_amount - discount THEN 'final_mismatch' END,
    CASE WHEN id IS NOT NULL AND advance_paid IS NULL THEN 'advance_missing' END,
    CASE WHEN advance_paid <> paid THEN 'advance_not_payments' END,
    CASE WHEN id IS NOT NULL AND balance IS NULL THEN 'balance_missing' END,
    CASE WHEN balance <> final_amount - advance_paid THEN 'balance_not_advance' END,
    CASE WHEN balance <> final_amount - paid THEN 'balance_not_payments' END,
    CASE WHEN paid > final_amount THEN 'overpaid' END,
    CASE WHEN id IS NULL THEN 'payments_without_booking' END) AS issues FROM j)
SELECT * FROM i WHERE issues <> ''""")
def booking_reconciliation(t):
    return Q.reconcile_bookings(t.stored_bookings, t.payments)


@register("export_stored_bookings", family="records", oracle="""
SELECT b.booking_id, l.customer_name, l.mobile, l.tour_name, l.travel_date, b.total_amount, b.discount, b.final_amount,
       b.advance_paid, b.balance, b.payment_method, b.payment_date, u.full_name AS staff, b.created_at
FROM crm_stored_bookings b LEFT JOIN crm_leads l ON b.lead_id = l.id LEFT JOIN crm_users u ON b.user_id = u.id""")
def export_stored_bookings(t):
    return X.export_bookings(t.stored_bookings, t.leads, t.users)


# -- J14: typed numbers against leads -----------------------------------------------------

_TYPED = """
SELECT request_id AS typed_id,
  CASE request_id % 11 WHEN 0 THEN concat('  ', mobile, ' ') WHEN 1 THEN substr(mobile, 1, 9)
    WHEN 2 THEN substr(mobile, 2, 9) WHEN 3 THEN concat('TOUR ', substr(mobile, 6, 5)) WHEN 4 THEN mobile
    WHEN 5 THEN concat('8', substr(mobile, 2)) WHEN 6 THEN concat('lead-19', substr(mobile, 9, 2), '-000')
    WHEN 7 THEN NULL WHEN 8 THEN concat(mobile, '0') WHEN 9 THEN 'tour united' ELSE mobile END AS text,
  CASE WHEN request_id % 3 = 0 THEN 'staff' WHEN request_id % 3 = 1 THEN 'admin' END AS role, actor_id AS user_id
FROM {requests} WHERE request_id % 40 < 5"""


@register("duplicate_candidates", family="records", oracle=f"""
WITH typed AS ({_TYPED.format(requests="crm_lead_requests")}),
asked AS (SELECT list({{'t': typed_id, 'q': lower(trim(text)), 'u': CASE WHEN role = 'staff' THEN user_id END}}) AS qs FROM typed
  WHERE length(trim(text)) >= 10),
l AS (SELECT *, lower(concat_ws(chr(10), customer_name, mobile, alt_mobile, tour_name, lead_id)) AS low FROM crm_leads),
found AS (SELECT unnest(list_filter(qs, lambda x: contains(low, x.q) AND (x.u IS NULL OR x.u = assigned_to))).t AS typed_id,
  id, lead_id, customer_name, mobile, tour_name, status, created_at FROM l, asked),
hits AS (SELECT *, row_number() OVER (PARTITION BY typed_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rank FROM found)
SELECT typed_id, rank, id, lead_id, customer_name, mobile, tour_name, status, created_at FROM hits WHERE rank <= 20""")
def duplicate_candidates(t):
    typed = t.spark.sql(_TYPED, requests=t.lead_requests)
    return L.duplicate_candidates(t.leads, typed)


# -- S6: appends that may be retried -------------------------------------------------------

@register("append_notes", family="records", oracle="""
SELECT id, lead_id, user_id, note, color, 'day-' || id % 3 AS batch FROM crm_lead_notes""")
def append_notes(t):
    """Three batches; one is sent twice, and one again after a first attempt that wrote half of it."""
    notes = t.lead_notes
    path = scratch_path(t.spark, "appended-notes")
    day = F.col("id") % 3
    io.append_batch(notes.where(day == 0), path, "day-0")
    io.append_batch(notes.where((day == 1) & (F.col("id") % 2 == 0)), path, "day-1")
    for n in (1, 2, 2):
        io.append_batch(notes.where(day == n), path, f"day-{n}")
    return io.read_appended(t.spark, path, notes.schema)


# -- M13: notes that are stored, added and deleted -------------------------------------------

_BLANK = r"regexp_replace(COALESCE(note, ''), '^\s+|\s+$', '', 'g')"
UNKNOWN_NOTE = 10**12


def _note_changes(t):
    """Three of four notes are stored, the others come in (some of them blank).  Deletes: staff ask for their own notes
    and others', admins and requests without a role for any; some ids are unknown, some asked for twice, some without seq."""
    n, i = t.lead_notes, F.col("id")
    adds = n.where(i % 4 == 0).select(
        "id", F.col("lead_id").alias("lead_pk"), F.col("user_id").alias("actor_id"),
        F.when(i % 8 == 0, F.concat(F.lit("  "), "note", F.lit("\n"))).when(i % 12 == 0, F.lit(" \t")).otherwise(F.col("note")).alias("note"),
        F.when(i % 20 != 0, F.col("color")).alias("color"))

    def ask(rows, role, later=0):
        return rows.select((i + later * UNKNOWN_NOTE).alias("note_id"), F.when(i % 5 != 0, i).alias("seq"), role.alias("role"),
                           F.when(i % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("actor_id"))

    role = F.when(i % 7 == 0, F.lit(None)).when(i % 9 == 0, F.lit("admin")).otherwise(F.lit("staff"))
    deletes = (ask(n.where(i % 3 == 0), role).unionByName(ask(n.where(i % 9 == 0), F.lit("manager")))
               .unionByName(ask(n.where(i % 10 == 3), F.lit("admin"), 1)))
    return M.apply_notes(n.where(i % 4 != 0), adds, deletes)


_NOTES = f"""
n AS (SELECT id, lead_id, user_id, note, color FROM crm_lead_notes WHERE id % 4 <> 0
  UNION ALL SELECT id, lead_id, user_id, {_BLANK}, CASE WHEN id % 20 <> 0 THEN color ELSE 'yellow' END FROM crm_lead_notes
  WHERE id % 4 = 0 AND (id % 8 = 0 OR id % 12 <> 0) AND {_BLANK} <> ''),
one AS (SELECT id, CASE WHEN id % 5 <> 0 THEN id END AS seq, id % 7 <> 0 AND id % 9 = 0 AS any_note, id % 2 = 0 AS own
  FROM crm_lead_notes WHERE id % 3 = 0),
ask AS (SELECT * FROM one UNION ALL SELECT id, seq, TRUE, own FROM one WHERE id % 9 = 0),
fate AS (SELECT a.*, n.id IS NOT NULL AS found, any_note OR own AS may,
  row_number() OVER (PARTITION BY a.id, n.id IS NOT NULL AND (any_note OR own) ORDER BY a.seq) AS k
  FROM ask a LEFT JOIN n ON n.id = a.id)"""


@register("notes_after_changes", family="records", oracle=rf"""
WITH {_NOTES} SELECT * FROM n WHERE id NOT IN (SELECT id FROM fate WHERE found AND may)""")
def notes_after_changes(t):
    return _note_changes(t)["lead_notes"].select("id", "lead_id", "user_id", "note", "color")


@register("note_delete_rejects", family="records", oracle=rf"""
WITH {_NOTES} SELECT id AS request_key, seq, CASE WHEN found AND NOT may THEN 'Forbidden' ELSE 'Not found' END AS reason
FROM fate WHERE NOT found OR NOT may OR k > 1
UNION ALL SELECT id + {UNKNOWN_NOTE}, CASE WHEN id % 5 <> 0 THEN id END, 'Not found' FROM crm_lead_notes WHERE id % 10 = 3""")
def note_delete_rejects(t):
    return _note_changes(t)["rejects"]


# -- L5, L7: the order of sorted lists ----------------------------------------------------------

@register("followup_list_order", family="records", oracle=f"""
SELECT id, followup_date, row_number() OVER (ORDER BY followup_date NULLS FIRST, id) AS rank
FROM ({Li._FOLLOWUPS.format(extra="")}) f""")
def followup_list_order(t):
    rows = L.followup_list(t.followups, t.leads, t.users, P.FOLLOWUP_AS_OF, bucket="all")
    return L.with_rank(rows, None, ["followup_date", "id"]).select("id", "followup_date", "rank")


@register("staff_performance_order", family="records", oracle=f"""
SELECT id, revenue, row_number() OVER (ORDER BY revenue DESC, id) AS rank FROM ({Re._SCORECARD}) s""")
def staff_performance_order(t):
    rows = R.staff_performance(t.users, t.leads, t.conversations, t.bookings)
    return L.with_rank(rows, "revenue", ["id"]).select("id", "revenue", "rank")
