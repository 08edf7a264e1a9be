"""Intake validation (V1-V3) and consistency checks (V4).

Requests are split into accepted rows and rejects with a reason; the first
failing rule wins, in the order the intake endpoint applies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.dates import date_lit

# Allowed enum members and their defaults.
HOTEL_CATEGORIES = ["Budget", "Deluxe", "Premium"]
MEAL_PLANS = ["CP", "MAP", "AP", "EP"]
VEHICLE_TYPES = ["Sedan", "SUV", "Innova", "Tempo Traveller", "Mini Bus", "Bus"]
LEAD_SOURCES = ["Call", "Website", "WhatsApp", "Referral", "Walk-in", "Other"]
LEAD_STATUSES = ["New Lead", "Follow-up", "Negotiation", "Booked", "Lost"]
ENUMS = {
    "hotel_category": (HOTEL_CATEGORIES, "Budget"),
    "meal_plan": (MEAL_PLANS, "MAP"),
    "vehicle_type": (VEHICLE_TYPES, "Sedan"),
    "lead_source": (LEAD_SOURCES, "Call"),
    "status": (LEAD_STATUSES, "New Lead"),
}

# Reject messages of the intake endpoint.
MSG_REQUIRED = "customer_name and mobile are required"
MSG_TRAVEL_DATE = "Invalid travel_date format (use YYYY-MM-DD)"
MSG_ENQUIRY_DATE = "Invalid enquiry_date format (use YYYY-MM-DD)"
MSG_ASSIGNEE = "Invalid assigned_to user id: "

REQUEST_DEFAULTS = {
    "customer_name": "string", "mobile": "string", "alt_mobile": "string", "email": "string",
    "city": "string", "tour_name": "string", "travel_date": "string",
    "pickup_location": "string", "drop_location": "string", "adults": "int",
    "children": "int", "hotel_category": "string", "meal_plan": "string",
    "vehicle_type": "string", "lead_source": "string", "assigned_to": "bigint",
    "status": "string", "enquiry_date": "string", "notes": "string",
    "created_at": "timestamp_ntz",
}


def conform_requests(requests: DataFrame) -> DataFrame:
    """Add absent request fields as NULL so every rule sees every column."""
    missing = [F.lit(None).cast(typ).alias(name) for name, typ in REQUEST_DEFAULTS.items()
               if name not in requests.columns]
    return requests.select("*", *missing)


def _falsy(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def _bad_date(c: Column) -> Column:
    """Set (non-empty) but not a YYYY-MM-DD calendar date."""
    parsed = F.try_to_date(c, "yyyy-M-d")
    return ~_falsy(c) & (parsed.isNull() | ~c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"))


def coerce_enums(df: DataFrame) -> DataFrame:
    """V1: values outside an enum become its default."""
    out = df
    for name, (allowed, default) in ENUMS.items():
        out = out.withColumn(name, F.when(F.col(name).isin(allowed), F.col(name)).otherwise(default))
    return out


def effective_assignee(df: DataFrame) -> Column:
    """``assigned_to or actor``: NULL and 0 both fall back to the actor."""
    a = F.col("assigned_to")
    return F.when(a.isNull() | (a == 0), F.col("actor_id")).otherwise(a)


def validate_lead_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """V2: every request with ``reject_reason`` (NULL when accepted)."""
    r = conform_requests(requests).withColumn("eff_assignee", effective_assignee(requests))
    ids = users.select(F.col("id").alias("_uid"))
    r = r.join(ids, r["eff_assignee"] == ids["_uid"], "left")
    reason = (F.when(_falsy(F.col("customer_name")) | _falsy(F.col("mobile")), F.lit(MSG_REQUIRED))
              .when(_bad_date(F.col("travel_date")), F.lit(MSG_TRAVEL_DATE))
              .when(_bad_date(F.col("enquiry_date")), F.lit(MSG_ENQUIRY_DATE))
              .when(F.col("_uid").isNull(),
                    F.concat(F.lit(MSG_ASSIGNEE), F.col("eff_assignee").cast("string"))))
    return r.withColumn("reject_reason", reason).drop("_uid")


def lead_intake_rejects(requests: DataFrame, users: DataFrame) -> DataFrame:
    v = validate_lead_requests(requests, users)
    return v.where(F.col("reject_reason").isNotNull()).select("request_id", "reject_reason")


def lead_intake_good(requests: DataFrame, users: DataFrame, as_of_day: str) -> DataFrame:
    """V1 + V3: accepted requests, typed, coerced, with defaults filled."""
    v = validate_lead_requests(requests, users).where(F.col("reject_reason").isNull())
    v = coerce_enums(v)
    return v.select(
        "request_id", "actor_id", "customer_name", "mobile", "alt_mobile", "email", "city",
        "tour_name",
        F.try_to_date(F.when(~_falsy(F.col("travel_date")), F.col("travel_date")),
                      "yyyy-M-d").alias("travel_date"),
        "pickup_location", "drop_location",
        F.coalesce(F.col("adults"), F.lit(1)).cast("int").alias("adults"),
        F.coalesce(F.col("children"), F.lit(0)).cast("int").alias("children"),
        "hotel_category", "meal_plan", "vehicle_type", "lead_source", "status",
        F.col("eff_assignee").cast("bigint").alias("assigned_to"),
        F.coalesce(F.try_to_date(F.when(~_falsy(F.col("enquiry_date")), F.col("enquiry_date")),
                                 "yyyy-M-d"),
                   date_lit(as_of_day)).alias("enquiry_date"),
        "notes", "created_at")


def booked_status_mismatch(leads: DataFrame, bookings: DataFrame) -> DataFrame:
    """V4: 'Booked' status without a booking, a booking on a non-Booked lead,
    or a booking whose lead does not exist (full outer join on lead id)."""
    l = leads.select(F.col("id").alias("l_id"), "status")
    b = (bookings.groupBy(F.col("lead_id").alias("b_lead"))
         .agg(F.count(F.lit(1)).alias("n_bookings")))
    j = l.join(b, l["l_id"] == b["b_lead"], "full")
    issue = (F.when(F.col("l_id").isNull(), "booking_without_lead")
             .when(F.col("b_lead").isNull() & (F.col("status") == "Booked"), "booked_without_booking")
             .when(F.col("b_lead").isNotNull() & (F.col("status") != "Booked"), "booking_not_booked"))
    return (j.select(F.coalesce("l_id", "b_lead").alias("lead_pk"), "status",
                     F.coalesce("n_bookings", F.lit(0)).alias("n_bookings"), issue.alias("issue"))
            .where(F.col("issue").isNotNull()))


def booking_amount_mismatch(bookings: DataFrame, balances: DataFrame) -> DataFrame:
    """V4: final ≠ total − discount, or balance not in [.., final] (overpaid)."""
    b = bookings.select("id", "total_amount", "discount", "final_amount")
    bal = balances.select(F.col("id").alias("_bid"), "balance")
    j = b.join(bal, b["id"] == bal["_bid"], "left")
    issue = (F.when(F.col("final_amount") != F.col("total_amount") - F.col("discount"), "final_mismatch")
             .when(F.col("balance") < 0, "overpaid"))
    return j.select("id", "final_amount", "balance", issue.alias("issue")).where(F.col("issue").isNotNull())


RECONCILE_ISSUES = ("final_mismatch", "advance_missing", "advance_not_payments", "balance_missing", "balance_not_advance",
                    "balance_not_payments", "overpaid", "payments_without_booking")


def reconcile_bookings(bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """V4: stored amounts against each other and against the payments.

    Three sources are compared: the stored advance, the stored balance and the
    sum of payments (reduced per booking before the full join, so a booking
    with many payments sends one row a task).  Lists each booking with at least
    one issue, and payments whose booking is not stored.  ``issues`` holds, in the
    order of ``RECONCILE_ISSUES`` and comma-joined: final amount other than total
    less discount; advance or balance absent; advance other than the payments;
    balance other than final less advance, or final less payments; more paid than due.
    """
    money = "decimal(18,2)"
    paid = payments.groupBy(F.col("booking_id").alias("_b")).agg(F.sum("amount").cast(money).alias("_paid"))
    b = bookings.select("id", "total_amount", "discount", "final_amount", "advance_paid", "balance")
    j = b.join(paid, b["id"] == paid["_b"], "full")
    total = F.coalesce(F.col("_paid"), F.lit(0)).cast(money)
    known, final = F.col("id").isNotNull(), F.col("final_amount")
    tests = [known & (final != F.col("total_amount") - F.col("discount")),
             known & F.col("advance_paid").isNull(),
             F.col("advance_paid") != total,
             known & F.col("balance").isNull(),
             F.col("balance") != final - F.col("advance_paid"),
             F.col("balance") != final - total,
             known & (total > final),
             ~known]
    issues = F.concat_ws(",", *[F.when(test, name) for name, test in zip(RECONCILE_ISSUES, tests)])
    return (j.select(F.coalesce("id", "_b").alias("booking_pk"), "advance_paid", "balance", total.alias("paid"),
                     (final - total).cast(money).alias("due"), issues.alias("issues"))
            .where(F.col("issues") != ""))
