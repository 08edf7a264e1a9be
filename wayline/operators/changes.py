"""Change-set operators: the reference's row-at-a-time writes as batch transforms.

Contract: ``apply_x(tables, changes, as_of, ...) -> dict[str, DataFrame]``.
``changes`` is a DataFrame of requests (one row per request, with a ``seq``
column giving request order).  The result holds new versions of the touched
tables, ``rejects`` (request key + reason) and ``audit`` rows; callers commit
them together (see ``wayline.sources.store``).

Shape rules that keep every operator safe on skewed batches:

* requests are reduced per target key with aggregates (``min_by``/``max_by``
  on ``seq``) before they meet the target table, so the join to a table is
  1:1 and never fans out, however many requests hit one key;
* a request's fate ("first request for this lead wins") is decided by
  joining it back to that per-key summary on (key, seq), not by windows;
* children of deleted rows are removed with anti-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.codes import BOOKING_CODE_RE, code_suffix, code_year, format_code
from wayline.functions.dates import date_lit, ts_lit
from wayline.functions.jsonpkg import SCHEMAS
from wayline.functions.predicates import py_strip
from wayline.operators.sequence import position_within, row_hash

AUDIT_COLUMNS = ["user_id", "action", "entity_type", "entity_id", "details", "created_at"]

# The editable lead fields of a partial update.
LEAD_UPDATE_FIELDS = [
    "customer_name", "mobile", "alt_mobile", "email", "city", "tour_name", "travel_date",
    "pickup_location", "drop_location", "adults", "children", "hotel_category", "meal_plan",
    "vehicle_type", "lead_source", "assigned_to", "status", "notes",
]


def audit(df: DataFrame, user: Column, action: str, entity_type: str | None,
          entity_id: Column, details: Column, as_of: str) -> DataFrame:
    """One audit row per accepted change."""
    return df.select(user.cast("bigint").alias("user_id"), F.lit(action).alias("action"),
                     F.lit(entity_type).cast("string").alias("entity_type"),
                     entity_id.cast("bigint").alias("entity_id"),
                     details.cast("string").alias("details"),
                     ts_lit(as_of).alias("created_at"))


def py_str(c: Column) -> Column:
    """Python's str() of a nullable value (None prints as 'None')."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def first_per_key(changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Mark one request per key as the first (``_first``) without a window.

    Requests that tie on ``seq`` are ordered by a hash of all their columns;
    equal requests are counted together, and only one of them is the first.
    """
    place = in_turn(changes, seq)
    counted = changes.groupBy(*changes.columns).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    firsts = counted.groupBy(F.col(key).alias("_fk")).agg(F.min(place).alias("_at"))
    j = counted.join(firsts, F.col(key).eqNullSafe(F.col("_fk")), "left")
    j = j.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return j.select(*changes.columns, ((F.col("_i") == 1) & place.eqNullSafe(F.col("_at"))).alias("_first"))


def in_turn(changes: DataFrame, seq: str = "seq") -> Column:
    """Sort key of a request: its ``seq`` (NULL first), then a hash of the row."""
    return F.struct(F.col(seq).alias("s"), row_hash(changes).alias("h"))


def _applied(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("request_key"), F.col("seq").cast("bigint").alias("seq"))


def _rejects(df: DataFrame, key: str, reason: Column) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("request_key"),
                     F.col("seq").cast("bigint").alias("seq"), reason.alias("reason"))


# -- M1 lead creation -------------------------------------------------------------

def apply_create_leads(leads: DataFrame, users: DataFrame, requests: DataFrame,
                       as_of: str) -> dict[str, DataFrame]:
    """M1: validate (V2), coerce (V1), default (V3) and insert new leads.

    Codes continue the ``LEAD-<year of as_of>-%05d`` sequence after the code
    of the highest existing id of that year; new ids continue after the
    largest id.  Both follow request order (``request_id``), computed with
    bounded blocks rather than one window over the batch.
    """
    from wayline.operators.quality import lead_intake_good, validate_lead_requests

    year = int(as_of[:4])
    checked = validate_lead_requests(requests, users)
    rejects = checked.where(F.col("reject_reason").isNotNull()).select(
        F.col("request_id").cast("bigint").alias("request_key"),
        F.col("request_id").cast("bigint").alias("seq"), F.col("reject_reason").alias("reason"))
    good = lead_intake_good(requests, users, as_of[:10]).withColumn("_y", F.lit(year))
    good = position_within(good, "_y", "request_id", out_col="_pos")
    max_id = leads.select(F.max("id")).scalar()
    last_code = (leads.where(F.col("lead_id").startswith(f"LEAD-{year}-"))
                 .select(F.max_by("lead_id", "id")).scalar())
    base = F.coalesce(code_suffix(last_code), F.lit(0))
    new = good.select(
        (F.coalesce(max_id, F.lit(0)) + F.col("_pos")).cast("bigint").alias("id"),
        format_code("LEAD", F.lit(year), base + F.col("_pos")).alias("lead_id"),
        "customer_name", "mobile", "alt_mobile", "email", "city", "tour_name", "travel_date",
        "pickup_location", "drop_location",
        "adults", "children", "hotel_category", "meal_plan", "vehicle_type", "lead_source",
        "assigned_to", "status", "enquiry_date", "notes", ts_lit(as_of).alias("created_at"),
        F.lit(0).alias("is_deleted"), F.col("actor_id"), F.col("request_id"))
    aud = audit(new, F.col("actor_id"), "CREATE_LEAD", "lead", F.col("id"),
                F.concat(F.lit("Created lead "), F.col("lead_id")), as_of)
    applied = new.select(F.col("request_id").cast("bigint").alias("request_key"), F.col("request_id").cast("bigint").alias("seq"))
    return {"leads_new": new.drop("actor_id"), "rejects": rejects, "applied": applied, "audit": aud}


# -- M2 partial update ---------------------------------------------------------

def apply_lead_updates(leads: DataFrame, changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """M2: partial update; ``fields`` lists the keys present in each request.

    A field absent from ``fields`` keeps its value; present with NULL sets
    NULL.  Several requests for one lead apply in ``seq`` order (the last
    value of each field wins).  Deleted leads are updated too, and every
    request is audited, as the endpoint does.
    """
    fields = [f for f in LEAD_UPDATE_FIELDS if f in changes.columns and f in leads.columns]
    aggs = []
    for f in fields:
        has = F.array_contains(F.col("fields"), f)
        aggs.append(F.max(has.cast("int")).alias(f"_has_{f}"))
        aggs.append(F.max_by(F.col(f), F.when(has, F.col("_turn"))).alias(f"_new_{f}"))
    per_lead = changes.withColumn("_turn", in_turn(changes)).groupBy(F.col("lead_pk").alias("_lp")).agg(*aggs)
    j = leads.join(per_lead, leads["id"] == per_lead["_lp"], "left")
    out = j.select(*[
        (F.when(F.col(f"_has_{c}") == 1, F.col(f"_new_{c}").cast(leads.schema[c].dataType))
         .otherwise(F.col(c)).alias(c)) if c in fields else F.col(c)
        for c in leads.columns])
    aud = audit(changes, F.col("actor_id"), "UPDATE_LEAD", "lead", F.col("lead_pk"),
                F.concat(F.lit("Updated lead "), F.col("lead_pk").cast("string")), as_of)
    empty = _rejects(changes.limit(0), "lead_pk", F.lit(None).cast("string"))
    return {"leads": out, "rejects": empty, "applied": _applied(changes, "lead_pk"), "audit": aud}


# -- M3 / M4 soft delete and restore ----------------------------------------------

# Reject messages of the role checks.
MSG_FORBIDDEN = "Forbidden"
MSG_DELETE_FORBIDDEN = "Forbidden — only admin/manager can delete leads"
MANAGERS = ("admin", "manager")


def by_role(changes: DataFrame, roles: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(allowed, forbidden) requests; a batch without a ``role`` column was checked before."""
    if "role" not in changes.columns:
        return changes, changes.limit(0)
    ok = has_role(changes, roles)
    return changes.where(ok), changes.where(~ok)


def has_role(changes: DataFrame, roles: tuple[str, ...]) -> Column:
    """Whether a request's role is one of ``roles`` (a missing role is none of them; no ``role`` column: checked before)."""
    return F.coalesce(F.col("role").isin(*roles), F.lit(False)) if "role" in changes.columns else F.lit(True)


def _flag_change(leads: DataFrame, changes: DataFrame, want_deleted: int,
                 new_values: dict, reason: str, forbidden: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new leads, accepted requests, rejects): the first allowed request of a lead in the wanted state acts.

    New leads come from one join with the batch's first requests; the state test
    runs on the joined row.
    """
    allowed, barred = by_role(changes, MANAGERS)
    marked = first_per_key(allowed, "lead_pk")
    first = marked.where(F.col("_first")).select(F.col("lead_pk").alias("_a"), F.col("actor_id").alias("_actor"))
    j = leads.join(first, leads["id"] == first["_a"], "left")
    hit = F.col("_a").isNotNull() & (F.col("is_deleted") == want_deleted)
    out = j.select(*[F.when(hit, new_values[c]).otherwise(F.col(c)).cast(leads.schema[c].dataType).alias(c)
                     if c in new_values else F.col(c) for c in leads.columns])
    state = leads.select(F.col("id").alias("_lid"), F.col("is_deleted").alias("_del"), F.col("lead_id").alias("_code"))
    known = marked.join(state, marked["lead_pk"] == state["_lid"], "left")
    ok = F.coalesce(F.col("_first") & (F.col("_del") == want_deleted), F.lit(False))
    rejects = _rejects(known.where(~ok), "lead_pk", F.lit(reason)).union(_rejects(barred, "lead_pk", F.lit(forbidden)))
    return out, known.where(ok), rejects


def apply_soft_delete(leads: DataFrame, changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """M3: move live leads to the trash (stamp time and actor); others and staff requests rejected."""
    out, acc, rej = _flag_change(
        leads, changes, 0, {"is_deleted": F.lit(1), "deleted_at": ts_lit(as_of), "deleted_by": F.col("_actor")},
        "Not found", MSG_DELETE_FORBIDDEN)
    aud = audit(acc, F.col("actor_id"), "SOFT_DELETE_LEAD", "lead", F.col("lead_pk"),
                F.concat(F.lit("Soft-deleted lead "), F.col("_code")), as_of)
    return {"leads": out, "rejects": rej, "applied": _applied(acc, "lead_pk"), "audit": aud}


def apply_restore(leads: DataFrame, changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """M4: bring trashed leads back (clear time and actor); live ones and staff requests rejected."""
    out, acc, rej = _flag_change(
        leads, changes, 1, {"is_deleted": F.lit(0), "deleted_at": F.lit(None), "deleted_by": F.lit(None)},
        "Not found or not deleted", MSG_FORBIDDEN)
    aud = audit(acc, F.col("actor_id"), "RESTORE_LEAD", "lead", F.col("lead_pk"),
                F.concat(F.lit("Restored lead "), F.col("_code")), as_of)
    return {"leads": out, "rejects": rej, "applied": _applied(acc, "lead_pk"), "audit": aud}


# -- M5 hard delete with cascade -----------------------------------------------------

LEAD_CHILDREN = ("followups", "conversations", "packages", "whatsapp_logs", "lead_notes")


def apply_hard_delete(tables: dict[str, DataFrame], changes: DataFrame,
                      as_of: str) -> dict[str, DataFrame]:
    """M5: permanently delete trashed leads (admin only) and all their children.

    The first allowed request of a trashed lead deletes it; a later one finds
    nothing in the trash.  Children keyed by lead id are anti-joined with the
    deleted ids; payments go through the deleted leads' bookings.
    """
    leads = tables["leads"]
    trash = leads.where(F.col("is_deleted") == 1).select(F.col("id").alias("_lid"),
                                                         F.col("lead_id").alias("_code"))
    allowed, barred = by_role(changes, ("admin",))
    marked = first_per_key(allowed, "lead_pk")
    c = marked.join(trash, marked["lead_pk"] == trash["_lid"], "left")
    ok = F.col("_first") & F.col("_lid").isNotNull()
    acc = c.where(ok)
    gone = acc.select(F.col("lead_pk").alias("_gone")).distinct()
    out: dict[str, DataFrame] = {}
    for name in LEAD_CHILDREN:
        if name in tables:
            t = tables[name]
            out[name] = t.join(gone, t["lead_id"] == gone["_gone"], "left_anti")
    bookings = tables["bookings"]
    gone_bookings = (bookings.join(gone, bookings["lead_id"] == gone["_gone"], "left_semi")
                     .select(F.col("id").alias("_gb")))
    pay = tables["payments"]
    out["payments"] = pay.join(gone_bookings, pay["booking_id"] == gone_bookings["_gb"], "left_anti")
    out["bookings"] = bookings.join(gone, bookings["lead_id"] == gone["_gone"], "left_anti")
    out["leads"] = leads.join(gone, leads["id"] == gone["_gone"], "left_anti")
    out["rejects"] = _rejects(c.where(~ok), "lead_pk", F.lit("Not found in trash")).union(
        _rejects(barred, "lead_pk", F.lit(MSG_FORBIDDEN)))
    out["applied"] = _applied(acc, "lead_pk")
    out["audit"] = audit(acc, F.col("actor_id"), "PERMANENT_DELETE_LEAD", "lead", F.col("lead_pk"),
                         F.concat(F.lit("Permanently deleted lead "), F.col("_code")), as_of)
    out["_gone"] = gone
    return out


def hard_delete_counts(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """Rows before / after a hard delete, per table, in one pass each."""
    parts = []
    keyed = {name: "lead_id" for name in LEAD_CHILDREN}
    keyed.update({"bookings": "lead_id", "leads": "id"})
    for name, key in keyed.items():
        if name not in tables:
            continue
        t = tables[name]
        j = t.join(gone, t[key] == gone["_gone"], "left")
        parts.append(j.agg(F.count(F.lit(1)).alias("rows_before"),
                           F.count_if(F.col("_gone").isNull()).alias("rows_after"))
                     .select(F.lit(name).alias("table_name"), "rows_before", "rows_after"))
    b = tables["bookings"]
    gb = b.join(gone, b["lead_id"] == gone["_gone"], "left_semi").select(F.col("id").alias("_gb"))
    p = tables["payments"].join(gb, F.col("booking_id") == F.col("_gb"), "left")
    parts.append(p.agg(F.count(F.lit(1)).alias("rows_before"),
                       F.count_if(F.col("_gb").isNull()).alias("rows_after"))
                 .select(F.lit("payments").alias("table_name"), "rows_before", "rows_after"))
    return reduce(DataFrame.unionByName, parts)


# -- M6 reassignment ---------------------------------------------------------------

def apply_reassign(leads: DataFrame, changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """M6: set a new assignee and log (lead, from, to, by) history rows.

    The previous assignee of the first request of a lead is the stored one;
    for later requests in the same batch it is the previous request's new
    assignee (each request is joined to the one just before it in ``seq``).
    """
    cur = leads.select(F.col("id").alias("_lid"), F.col("assigned_to").alias("_old"))
    c = changes.join(cur, changes["lead_pk"] == cur["_lid"], "left")
    new = F.col("new_assignee")
    reason = (F.when(~has_role(changes, MANAGERS), MSG_FORBIDDEN)
              .when(new.isNull() | (new == 0), "assigned_to is required")
              .when(F.col("_lid").isNull(), "Lead not found"))
    c = c.withColumn("_reason", reason)
    acc = c.where(F.col("_reason").isNull())
    # Position of each accepted request within its lead (range partitions, no
    # per-lead window), then the predecessor is the row at position - 1.
    acc = position_within(acc, "lead_pk", "seq", out_col="_pos")
    prev = acc.select(F.col("lead_pk").alias("_pl"), (F.col("_pos") + 1).alias("_pp"),
                      F.col("new_assignee").alias("_pnew"))
    a = acc.join(prev, (acc["lead_pk"] == prev["_pl"]) & (acc["_pos"] == prev["_pp"]), "left")
    from_ = F.when(F.col("_pos") == 1, F.col("_old")).otherwise(F.col("_pnew"))
    per_lead = (acc.groupBy(F.col("lead_pk").alias("_pl"))
                .agg(F.max_by("new_assignee", "_pos").alias("_last")))
    hist = a.select(F.col("lead_pk").alias("lead_id"), from_.cast("bigint").alias("assigned_from"),
                    F.col("new_assignee").cast("bigint").alias("assigned_to"),
                    F.col("actor_id").cast("bigint").alias("assigned_by"),
                    F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
                    ts_lit(as_of).alias("created_at"), F.col("seq"))
    j = leads.join(per_lead, leads["id"] == per_lead["_pl"], "left")
    out = j.select(*[
        F.when(F.col("_pl").isNotNull(), F.col("_last")).otherwise(F.col(c))
        .cast(leads.schema[c].dataType).alias(c) if c == "assigned_to" else F.col(c)
        for c in leads.columns])
    aud = audit(hist, F.col("assigned_by"), "REASSIGN_LEAD", "lead", F.col("lead_id"),
                F.concat(F.lit("Reassigned lead "), F.col("lead_id").cast("string"), F.lit(" from user "),
                         py_str(F.col("assigned_from")), F.lit(" to "), F.col("assigned_to").cast("string")),
                as_of)
    return {"leads": out, "lead_assignments": hist.drop("seq"),
            "rejects": _rejects(c.where(F.col("_reason").isNotNull()), "lead_pk", F.col("_reason")),
            "applied": _applied(acc, "lead_pk"), "audit": aud}


# -- M7 conversation fan-out ----------------------------------------------------------

def apply_conversations(leads: DataFrame, changes: DataFrame, as_of: str,
                        followups: DataFrame | None = None) -> dict[str, DataFrame]:
    """M7: each request adds a conversation, a Pending follow-up when a next
    date is given, and a lead status change when ``status_update`` is set
    (the latest request per lead by ``seq`` wins).  Unknown leads are rejected.

    With the stored ``followups``, ids of new ones continue after the largest in
    order of ``conv_id``; without, a follow-up is named by its conversation.
    """
    ids = leads.select(F.col("id").alias("_lid"))
    c = changes.join(ids, changes["lead_pk"] == ids["_lid"], "left")
    acc = c.where(F.col("_lid").isNotNull())
    rej = c.where(F.col("_lid").isNull())
    conv = acc.select(
        F.col("conv_id").alias("id"), F.col("lead_pk").alias("lead_id"),
        F.col("actor_id").alias("user_id"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("call_result", F.lit("")).alias("call_result"),
        F.coalesce("call_type", F.lit("Outgoing")).alias("call_type"),
        "next_followup_date", "created_at")
    fu = acc.where(F.col("next_followup_date").isNotNull()).select(
        F.col("conv_id").alias("id"), F.col("lead_pk").alias("lead_id"),
        F.col("actor_id").alias("user_id"), F.col("next_followup_date").alias("followup_date"),
        F.coalesce("summary", F.lit("")).alias("notes"), F.lit("Pending").alias("status"),
        F.col("created_at"))
    if followups is not None:
        last = F.coalesce(followups.select(F.max("id")).scalar(), F.lit(0))
        numbered = position_within(fu.withColumn("_one", F.lit(1)), "_one", "id", out_col="_pos")
        fu = numbered.select(*[(last + F.col("_pos")).cast("bigint").alias("id") if c == "id" else c for c in fu.columns])
    su = F.col("status_update")
    status = (acc.where(su.isNotNull() & (su != ""))
              .groupBy(F.col("lead_pk").alias("_sl"))
              .agg(F.max_by("status_update", F.struct("seq", "status_update")).alias("_st")))
    j = leads.join(status, leads["id"] == status["_sl"], "left")
    new_leads = j.select(*[
        F.coalesce(F.col("_st"), F.col(c)).alias(c) if c == "status" else F.col(c)
        for c in leads.columns])
    aud = audit(acc, F.col("actor_id"), "ADD_CONVERSATION", "lead", F.col("lead_pk"),
                F.concat(F.lit("Added conversation to lead "), F.col("lead_pk").cast("string")), as_of)
    return {"conversations": conv, "followups": fu, "leads": new_leads, "lead_status": status,
            "rejects": _rejects(rej, "lead_pk", F.lit("Lead not found")),
            "applied": _applied(acc, "lead_pk"), "audit": aud}


# -- M8 follow-up completion -----------------------------------------------------------

def apply_complete_followups(followups: DataFrame, changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """M8: mark follow-ups Completed at ``as_of`` (no status check)."""
    ids = changes.select(F.col("followup_id").alias("_fid")).distinct()
    j = followups.join(ids, followups["id"] == ids["_fid"], "left")
    hit = F.col("_fid").isNotNull()
    cols = [F.when(hit, F.lit("Completed")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
            for c in followups.columns]
    prev_done = F.col("completed_at") if "completed_at" in followups.columns else F.lit(None)
    cols = [c for c, n in zip(cols, followups.columns) if n != "completed_at"]
    cols.append(F.when(hit, ts_lit(as_of)).otherwise(prev_done).cast("timestamp_ntz").alias("completed_at"))
    return {"followups": j.select(*cols)}


# -- M9 packages -------------------------------------------------------------------------

def apply_packages(packages: DataFrame, changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """M9: create or replace packages; JSON members are encoded with ``to_json``.

    ``changes`` carries ``op`` ('create' | 'update'), ``package_id`` (updates),
    ``lead_pk``, ``actor_id`` and typed members (``itinerary`` ... as arrays /
    structs).  An update overwrites every field; a missing member becomes its
    default (empty list, empty object, 0, '').  New ids continue after the
    current maximum, in request order.  Of several updates of a package the last
    one stays (one row, whatever ties); updates of unknown packages and requests
    with another ``op`` are rejected.
    """
    def enc(name: str) -> Column:
        if name not in changes.columns:
            return F.lit("{}" if name == "transport" else "[]")
        empty = F.lit("{}") if name == "transport" else F.lit("[]")
        return F.coalesce(F.to_json(F.col(name)), empty)

    def num(name: str) -> Column:
        return (F.coalesce(F.col(name), F.lit(0)) if name in changes.columns else F.lit(0)).cast("decimal(10,2)")

    def txt(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in changes.columns else F.lit("")

    body = [txt("tour_name").alias("tour_name"), enc("itinerary").alias("itinerary"),
            enc("hotels").alias("hotels"), enc("transport").alias("transport"),
            enc("other_charges").alias("other_charges"), num("base_price").alias("base_price"),
            num("discount").alias("discount"), num("final_price").alias("final_price"),
            txt("notes").alias("notes")]
    creates = changes.where(F.col("op") == "create").withColumn("_one", F.lit(1))
    max_id = packages.select(F.max("id")).scalar()
    creates = position_within(creates, "_one", "seq", out_col="_pos")
    new_rows = creates.select((F.coalesce(max_id, F.lit(0)) + F.col("_pos")).alias("id"),
                              F.col("lead_pk").alias("lead_id"), F.col("actor_id").alias("user_id"),
                              *body)
    known = packages.select(F.col("id").alias("_known"))
    upd = changes.where(F.col("op") == "update").join(known, F.col("package_id") == F.col("_known"), "left")
    found = upd.where(F.col("_known").isNotNull()).drop("_known")
    last = found.groupBy(F.col("package_id").alias("_uid")).agg(
        F.max_by(F.struct(*body), in_turn(found)).alias("_b"))
    upd_rows = last.select("_uid", "_b.*")
    other = changes.where(~F.coalesce(F.col("op").isin("create", "update"), F.lit(False)))
    rejects = _rejects(upd.where(F.col("_known").isNull()), "package_id", F.lit("Not found")).union(
        _rejects(other, "package_id", F.lit("Unknown operation")))
    applied = _applied(creates, "package_id").union(_applied(found, "package_id"))
    keep_cols = [c for c in ("id", "lead_id", "user_id") if c in packages.columns]
    cur = packages.select(*keep_cols)
    replaced = cur.join(upd_rows, cur["id"] == upd_rows["_uid"], "inner").drop("_uid")
    body_names = ["tour_name", "itinerary", "hotels", "transport", "other_charges",
                  "base_price", "discount", "final_price", "notes"]
    untouched = (packages.join(upd_rows.select("_uid"), packages["id"] == F.col("_uid"), "left_anti")
                 .select(*keep_cols, *[F.col(n) if n in packages.columns else F.lit(None).alias(n)
                                       for n in body_names]))
    cast_body = lambda df: df.select(*keep_cols, *[F.col(n).cast(t) for n, t in
                                                   zip(body_names, ["string"] * 5 + ["decimal(10,2)"] * 3 + ["string"])])
    out = reduce(DataFrame.unionByName, [cast_body(untouched), cast_body(replaced), cast_body(new_rows)])
    return {"packages": out, "rejects": rejects, "applied": applied}


# -- M10 bookings ---------------------------------------------------------------------

def apply_bookings(tables: dict[str, DataFrame], changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Create bookings for live, not-yet-booked leads.

    Code = ``BOOKING-<year of as_of>-%05d`` continuing after the year's largest
    well-formed code; new ids continue after the largest booking id; both in
    request order.  Each accepted booking sets its lead to 'Booked' and, when
    the advance is positive, adds an advance payment row.  A second request
    for the same lead in one batch is rejected like an existing booking.
    """
    leads, bookings = tables["leads"], tables["bookings"]
    year = int(as_of[:4])
    live = leads.where(F.col("is_deleted") == 0).select(F.col("id").alias("_live"))
    existing = (bookings.groupBy(F.col("lead_id").alias("_bl"))
                .agg(F.min_by("booking_id", "id").alias("_existing_code")))
    c = (first_per_key(changes, "lead_pk")
         .join(live, F.col("lead_pk") == F.col("_live"), "left")
         .join(existing, F.col("lead_pk") == F.col("_bl"), "left"))
    found = F.col("_live").isNotNull()
    # Each request's fate is written once, with its position among those of the same fate.
    c = c.withColumn("_ok", found & F.col("_bl").isNull() & F.col("_first"))
    c = position_within(c, "_ok", "seq", out_col="_pos")
    acc = c.where("_ok")
    # Current maxima as scalar sub-queries (one value each, no join).
    max_id = bookings.select(F.max("id")).scalar()
    max_seq = bookings.where(F.col("booking_id").rlike(BOOKING_CODE_RE) &
                             (code_year(F.col("booking_id")) == year)).select(
        F.max(code_suffix(F.col("booking_id")))).scalar()
    seq_no = F.coalesce(max_seq, F.lit(0)) + F.col("_pos")
    dec = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("decimal(10,2)")
    pay_date = F.coalesce(F.try_to_date(F.col("payment_date"), "yyyy-M-d"), date_lit(as_of[:10]))
    new_b = acc.select(
        (F.coalesce(max_id, F.lit(0)) + F.col("_pos")).cast("bigint").alias("id"),
        format_code("BOOKING", F.lit(year), seq_no).alias("booking_id"),
        F.col("lead_pk").cast("bigint").alias("lead_id"), F.col("actor_id").cast("bigint").alias("user_id"),
        dec("total_amount").alias("total_amount"), dec("discount").alias("discount"),
        dec("final_amount").alias("final_amount"), dec("advance_paid").alias("advance_paid"),
        dec("balance").alias("balance"),
        F.coalesce(F.col("payment_method"), F.lit("Cash")).alias("payment_method"),
        pay_date.alias("payment_date"), F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
        ts_lit(as_of).alias("created_at"))
    pays = new_b.where(F.col("advance_paid") > 0).select(
        F.col("id").alias("booking_id"), F.col("advance_paid").alias("amount"), "payment_method",
        "payment_date", F.lit("Advance payment").alias("notes"))
    booked = new_b.select(F.col("lead_id").alias("_bk"))
    lj = leads.join(booked, leads["id"] == booked["_bk"], "left")
    new_leads = lj.select(*[F.when(F.col("_bk").isNotNull(), F.lit("Booked")).otherwise(F.col(x)).alias(x)
                            if x == "status" else F.col(x) for x in leads.columns])
    # A repeated request for a lead booked in this same batch names that booking.
    batch_codes = new_b.select(F.col("lead_id").alias("_nl"), F.col("booking_id").alias("_new_code"))
    rej = c.where("NOT _ok").join(
        batch_codes, F.col("lead_pk") == F.col("_nl"), "left")
    reason = (F.when(~found, F.lit("Lead not found"))
              .otherwise(F.concat(F.lit("Booking already exists for this lead: "),
                                  F.coalesce("_existing_code", "_new_code"))))
    aud = audit(new_b, F.col("user_id"), "CREATE_BOOKING", "booking", F.col("id"),
                F.concat(F.lit("Created booking "), F.col("booking_id"), F.lit(" for lead "),
                         F.col("lead_id").cast("string")), as_of)
    return {"bookings_new": new_b, "payments_new": pays, "leads": new_leads,
            "rejects": _rejects(rej, "lead_pk", reason), "applied": _applied(acc, "lead_pk"), "audit": aud}


# -- M11 payments ---------------------------------------------------------------------

# What a payment request without the field is stored with.
PAYMENT_DEFAULTS = {"payment_method": "Cash", "reference_no": "", "notes": ""}


def apply_payments(bookings: DataFrame, payments: DataFrame, changes: DataFrame,
                   as_of: str) -> dict[str, DataFrame]:
    """Append payments and recompute advance_paid / balance of the
    touched bookings from all their payments (so re-running recomputes the
    same values).  When requests carry ``payment_id``, ids already present
    in ``payments`` are skipped, which makes a replayed batch a no-op, and an
    id sent twice in a batch counts once (its first request by ``seq``).
    Payments for unknown bookings are rejected.  Absent fields get the
    defaults of ``PAYMENT_DEFAULTS`` and the day of ``as_of``.
    """
    ids = bookings.select(F.col("id").alias("_bid"))
    c = changes.join(ids, changes["booking_id"] == ids["_bid"], "left")
    acc = c.where(F.col("_bid").isNotNull()).drop("_bid")
    rej = c.where(F.col("_bid").isNull())
    if "payment_id" in acc.columns and "payment_id" in payments.columns:
        acc = acc.join(payments.select(F.col("payment_id").alias("_pid")),
                       F.col("payment_id") == F.col("_pid"), "left_anti")
        # one request per id; requests without an id are all their own
        acc = first_per_key(acc, "payment_id").where(F.col("_first") | F.col("payment_id").isNull()).drop("_first")
    defaults = {k: F.lit(v) for k, v in PAYMENT_DEFAULTS.items()} | {"payment_date": date_lit(as_of[:10])}
    new_pay = acc.select(*[
        F.coalesce(F.col(x), defaults[x]).alias(x) if x in acc.columns and x in defaults
        else F.col(x) if x in acc.columns else defaults[x].alias(x)
        for x in payments.columns if x in acc.columns or x in defaults])
    all_pay = payments.unionByName(new_pay, allowMissingColumns=True)
    # One pass over the payments: a booking is touched if one of them is new.
    sums = (payments.select("booking_id", "amount", F.lit(False).alias("_new"))
            .unionByName(new_pay.select("booking_id", "amount", F.lit(True).alias("_new")))
            .groupBy(F.col("booking_id").alias("_pb")).agg(F.sum("amount").alias("_paid"), F.max("_new").alias("_new")))
    paid = sums.where("_new").drop("_new")
    j = bookings.join(paid, bookings["id"] == paid["_pb"], "left")
    hit = F.col("_pb").isNotNull()
    out = j.select(*[
        F.when(hit, F.col("_paid")).otherwise(F.col(x)).cast("decimal(18,2)").alias(x) if x == "advance_paid"
        else F.when(hit, F.col("final_amount") - F.col("_paid")).otherwise(F.col(x)).cast("decimal(18,2)").alias(x)
        if x == "balance" else F.col(x) for x in bookings.columns])
    aud = audit(acc, F.col("actor_id") if "actor_id" in acc.columns else F.lit(None), "ADD_PAYMENT",
                "booking", F.col("booking_id"),
                F.concat(F.lit("Payment ₹"), F.col("amount").cast("string"), F.lit(" added to booking "),
                         F.col("booking_id").cast("string")), as_of)
    return {"bookings": out, "payments": all_pay,
            "rejects": _rejects(rej, "booking_id", F.lit("Booking not found")), "audit": aud}


# -- M12 / M13 WhatsApp log and notes ----------------------------------------------------

def apply_whatsapp(changes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Append stripped, non-empty messages; empty ones rejected."""
    msg = py_strip(F.coalesce(F.col("message"), F.lit("")))
    c = changes.withColumn("_msg", msg)
    acc = c.where(F.col("_msg") != "")
    rows = acc.select(F.col("lead_pk").alias("lead_id"), F.col("actor_id").alias("user_id"),
                      F.col("_msg").alias("message"), ts_lit(as_of).alias("created_at"))
    aud = audit(acc, F.col("actor_id"), "WHATSAPP_LOG", "lead", F.col("lead_pk"),
                F.concat(F.lit("WhatsApp logged for lead "), F.col("lead_pk").cast("string")), as_of)
    return {"whatsapp_logs_new": rows,
            "rejects": _rejects(c.where(F.col("_msg") == ""), "lead_pk", F.lit("Message required")),
            "audit": aud}


def apply_notes(notes: DataFrame, adds: DataFrame, deletes: DataFrame) -> dict[str, DataFrame]:
    """Add notes (stripped, non-empty; colour default yellow) and delete
    notes; staff may delete only their own notes, admins and managers any.

    Deletes see the notes that are stored and those of this batch.  The first
    allowed request deletes a note; a later one finds none.  A request without a
    role is a staff request.
    """
    text = py_strip(F.coalesce(F.col("note"), F.lit("")))
    a = adds.withColumn("_t", text)
    new = a.where(F.col("_t") != "").select(
        "id", F.col("lead_pk").alias("lead_id"), F.col("actor_id").alias("user_id"),
        F.col("_t").alias("note"), F.coalesce(F.col("color"), F.lit("yellow")).alias("color"))
    cur = notes.unionByName(new, allowMissingColumns=True)
    owner = cur.select(F.col("id").alias("_nid"), F.col("user_id").alias("_owner"))
    d = deletes.join(owner, deletes["note_id"] == owner["_nid"], "left")
    own = F.coalesce(F.col("_owner") == F.col("actor_id"), F.lit(False))
    d = d.withColumn("_may", F.col("_nid").isNotNull() & (has_role(deletes, MANAGERS) | own))
    marked = first_per_key(d.where("_may").select(*deletes.columns), "note_id")
    acc = marked.where("_first")
    gone = acc.select(F.col("note_id").alias("_g"))
    kept = cur.join(gone, cur["id"] == gone["_g"], "left_anti")
    missing, barred = d.where("_nid IS NULL"), d.where("NOT _may AND _nid IS NOT NULL")
    rejects = reduce(DataFrame.union, [
        _rejects(missing, "note_id", F.lit("Not found")), _rejects(marked.where("NOT _first"), "note_id", F.lit("Not found")),
        _rejects(barred, "note_id", F.lit(MSG_FORBIDDEN))])
    return {"lead_notes": kept, "rejects": rejects, "applied": _applied(acc, "note_id"),
            "note_rejects": a.where(F.col("_t") == "").select("id")}


# -- M14 / M15 categories --------------------------------------------------------------

# Fields of a new (or replaced) row that the request leaves out, and messages.
CATEGORY_DEFAULTS = {"description": "", "icon": "fa-map-marked-alt", "color": "#F97316", "sort_order": 0, "is_active": 1}
SUBCATEGORY_DEFAULTS = {"description": "", "tags": "", "sort_order": 0, "is_active": 1}
USER_DEFAULTS = {"email": "", "phone": "", "role": "staff", "is_active": 1}
MSG_NAME = "Name required"


def _upsert(table: DataFrame, upserts: DataFrame, defaults: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new table, accepted requests with ``_new_id`` and ``_created``, rejects) of upserts by ``id``.

    A request needs an admin or manager and a name (stripped).  Without an id it
    creates a row: ids continue after the table's largest in order of ``seq``
    (equal requests are one).  With an id it replaces all fields of that row, the
    last request by ``seq`` wins.  Fields left out take their defaults.
    """
    allowed, barred = by_role(upserts, MANAGERS)
    named = allowed.withColumn("name", py_strip(F.coalesce(F.col("name"), F.lit(""))))
    rejects = _rejects(named.where("name = ''"), "id", F.lit(MSG_NAME)).union(
        _rejects(barred, "id", F.lit(MSG_FORBIDDEN)))
    named = named.where("name <> ''").distinct()
    top = F.coalesce(table.select(F.max("id")).scalar(), F.lit(0))
    added = position_within(named.where("id is null").withColumn("_one", F.lit(1)), "_one", "seq", out_col="_pos")
    added = added.withColumn("_new_id", (top + F.col("_pos")).cast("bigint")).drop("_one", "_pos").withColumn("_created", F.lit(True))
    whole = F.struct(*named.columns)
    kept = (named.where("id is not null").groupBy(F.col("id").alias("_k"))
            .agg(F.max_by(whole, in_turn(named)).alias("_r")).select("_r.*"))
    kept = kept.withColumn("_new_id", F.col("id").cast("bigint")).withColumn("_created", F.lit(False))
    accepted = kept.unionByName(added)

    def value(c: str):
        given = F.col("_new_id") if c == "id" else F.col(c) if c in accepted.columns else F.lit(None)
        filled = F.coalesce(given, F.lit(defaults[c])) if c in defaults else given
        return filled.cast(table.schema[c].dataType).alias(c)

    rows = accepted.select(*[value(c) for c in table.columns])
    rest = table.join(rows.select(F.col("id").alias("_uid")), table["id"] == F.col("_uid"), "left_anti")
    return rest.unionByName(rows), accepted, rejects


def _no_rejects(df: DataFrame, key: str) -> DataFrame:
    return df.limit(0).select(F.col(key).cast("bigint").alias("request_key"), F.lit(0).cast("bigint").alias("seq"),
                              F.lit("").alias("reason"))


def apply_category_changes(categories: DataFrame, subcategories: DataFrame, upserts: DataFrame | None,
                           deletes: DataFrame | None, as_of: str = "1970-01-01 00:00:00") -> dict[str, DataFrame]:
    """Upsert categories (see ``_upsert``) and delete categories with their
    sub-categories (cascade; admin or manager).  Leads are not touched: their category id may now
    dangle (there is no foreign key).  Created categories are audited."""
    cats, subs = categories, subcategories
    rejects, aud = _no_rejects(categories, "id"), None
    if upserts is not None:
        cats, accepted, rejects = _upsert(categories, upserts, CATEGORY_DEFAULTS)
        actor = F.col("actor_id") if "actor_id" in accepted.columns else F.lit(None)
        aud = audit(accepted.where("_created"), actor, "CREATE_TOUR_CATEGORY", None, F.lit(None),
                    F.concat(F.lit("Created tour category: "), F.col("name")), as_of)
    if deletes is not None:
        allowed, barred = by_role(deletes, MANAGERS)
        if "seq" in deletes.columns:
            rejects = rejects.union(_rejects(barred, "category_id", F.lit(MSG_FORBIDDEN)))
        gone = allowed.select(F.col("category_id").alias("_gone")).distinct()
        cats = cats.join(gone, cats["id"] == gone["_gone"], "left_anti")
        subs = subs.join(gone, subs["category_id"] == gone["_gone"], "left_anti")
    out = {"tour_categories": cats, "tour_subcategories": subs, "rejects": rejects}
    return out | ({"audit": aud} if aud is not None else {})


def apply_subcategory_changes(subcategories: DataFrame, upserts: DataFrame | None,
                              deletes: DataFrame | None) -> dict[str, DataFrame]:
    """Upsert (see ``_upsert``) and delete sub-categories (admin or manager)."""
    subs, rejects = subcategories, _no_rejects(subcategories, "id")
    if upserts is not None:
        subs, _, rejects = _upsert(subcategories, upserts, SUBCATEGORY_DEFAULTS)
    if deletes is not None:
        allowed, barred = by_role(deletes, MANAGERS)
        if "seq" in deletes.columns:
            rejects = rejects.union(_rejects(barred, "id", F.lit(MSG_FORBIDDEN)))
        gone = allowed.select(F.col("id").alias("_gone")).distinct()
        subs = subs.join(gone, subs["id"] == gone["_gone"], "left_anti")
    return {"tour_subcategories": subs, "rejects": rejects}


def dangling_category_leads(leads: DataFrame, categories: DataFrame) -> DataFrame:
    """Leads whose category id names no category (after a delete)."""
    ids = categories.select(F.col("id").alias("_cid"))
    return (leads.where(F.col("tour_category_id").isNotNull())
            .join(ids, F.col("tour_category_id") == F.col("_cid"), "left_anti")
            .select("id", "lead_id", "tour_category_id"))


# -- M16 users ---------------------------------------------------------------------------

def apply_user_changes(users: DataFrame, creates: DataFrame | None = None,
                       updates: DataFrame | None = None, deactivate: DataFrame | None = None,
                       as_of: str = "1970-01-01 00:00:00") -> dict[str, DataFrame]:
    """Create users (role default 'staff', active), partial updates
    (``fields`` lists present keys) and deactivation (``is_active = 0``;
    leads keep their assignee).  Only admins may; other requests are rejected
    (batches without a ``role_of_actor`` column were checked before).  Creates without
    an id (or without that column) get ids after the largest, by ``seq``; they are audited."""
    rejects, aud = [], None

    def admins(batch: DataFrame, key: str) -> DataFrame:
        if "role_of_actor" not in batch.columns:
            return batch
        ok = F.coalesce(F.col("role_of_actor") == "admin", F.lit(False))
        keyed = batch if key in batch.columns else batch.withColumn(key, F.lit(None).cast("bigint"))
        rejects.append(_rejects(keyed.where(~ok), key, F.lit(MSG_FORBIDDEN)))
        return batch.where(ok)

    out = users
    if creates is not None:
        new = admins(creates, "id")
        if "seq" in new.columns:
            top = F.coalesce(users.select(F.max("id")).scalar(), F.lit(0))
            new = position_within(new.withColumn("_one", F.lit(1)), "_one", "seq", out_col="_pos")
            given = F.col("id") if "id" in creates.columns else F.lit(None)
            new = new.withColumn("id", F.coalesce(given, top + F.col("_pos")).cast("bigint"))
        actor = F.col("actor_id") if "actor_id" in new.columns else F.lit(None)
        aud = audit(new, actor, "CREATE_USER", None, F.lit(None), F.concat(F.lit("Created user "), "username"), as_of)
        new = new.select(*[(F.coalesce(F.col(c), F.lit(USER_DEFAULTS[c])) if c in USER_DEFAULTS else F.col(c)).alias(c)
                           if c in new.columns else F.lit(USER_DEFAULTS.get(c)).alias(c) for c in users.columns])
        out = out.unionByName(new.select(*[F.col(c).cast(users.schema[c].dataType).alias(c) for c in users.columns]))
    def known(batch: DataFrame) -> DataFrame:
        """Requests for users of this table; the others are rejected."""
        ids = out.select(F.col("id").alias("_known"))
        j = admins(batch, "user_pk").join(ids, F.col("user_pk") == F.col("_known"), "left")
        if "seq" in batch.columns:
            rejects.append(_rejects(j.where("_known IS NULL"), "user_pk", F.lit("Not found")))
        return j.where("_known IS NOT NULL").drop("_known")

    updates = None if updates is None else known(updates)
    deactivate = None if deactivate is None else known(deactivate)
    if updates is not None:
        editable = [c_ for c_ in ("full_name", "email", "phone", "role", "is_active")
                    if c_ in updates.columns and c_ in users.columns]
        aggs = []
        for f in editable:
            has = F.array_contains(F.col("fields"), f)
            aggs += [F.max(has.cast("int")).alias(f"_has_{f}"),
                     F.max_by(F.col(f), F.when(has, F.col("_turn"))).alias(f"_new_{f}")]
        per = updates.withColumn("_turn", in_turn(updates)).groupBy(F.col("user_pk").alias("_up")).agg(*aggs)
        j = out.join(per, out["id"] == per["_up"], "left")
        out = j.select(*[(F.when(F.col(f"_has_{c_}") == 1, F.col(f"_new_{c_}")).otherwise(F.col(c_))
                          .cast(users.schema[c_].dataType).alias(c_)) if c_ in editable else F.col(c_)
                         for c_ in users.columns])
    if deactivate is not None:
        gone = deactivate.select(F.col("user_pk").alias("_d")).distinct()
        j = out.join(gone, out["id"] == gone["_d"], "left")
        out = j.select(*[F.when(F.col("_d").isNotNull(), F.lit(0)).otherwise(F.col(c_))
                         .cast(users.schema[c_].dataType).alias(c_) if c_ == "is_active" else F.col(c_)
                         for c_ in users.columns])
    res = {"users": out, "rejects": reduce(DataFrame.union, rejects) if rejects else _no_rejects(users, "id")}
    return res | ({"audit": aud} if aud is not None else {})


def audit_union(*audits: DataFrame) -> DataFrame:
    """The audit rows of several accepted change sets, as one table."""
    return reduce(DataFrame.unionByName, [a.select(*AUDIT_COLUMNS) for a in audits])


__all__ = [n for n in dir() if n.startswith("apply_")] + [
    "audit", "audit_union", "dangling_category_leads", "hard_delete_counts", "first_per_key", "has_role", "in_turn"]
