"""CSV exports (S3, S4) and dimension seeding by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.lists import with_user_name
from wayline.sources.io import conform_entity

LEAD_EXPORT_COLUMNS = [
    "lead_id", "customer_name", "mobile", "alt_mobile", "email", "city", "tour_name",
    "travel_date", "adults", "children", "hotel_category", "meal_plan", "vehicle_type",
    "lead_source", "status", "enquiry_date", "assigned_to", "created_at"]

BOOKING_EXPORT_COLUMNS = [
    "booking_id", "customer_name", "mobile", "tour_name", "travel_date", "total_amount",
    "discount", "final_amount", "advance_paid", "balance", "payment_method", "payment_date",
    "staff", "created_at"]


def export_leads(leads: DataFrame, users: DataFrame) -> DataFrame:
    """S3: all leads (deleted included), assignee shown by name, newest first."""
    l = conform_entity(leads, "leads")
    named = with_user_name(l, users, "assigned_to", "_assignee_name")
    return (named.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
            .select(*[F.col("_assignee_name").alias("assigned_to") if c == "assigned_to" else F.col(c)
                      for c in LEAD_EXPORT_COLUMNS]))


def export_bookings(bookings: DataFrame, leads: DataFrame, users: DataFrame,
                    balances: DataFrame | None = None) -> DataFrame:
    """Bookings with customer fields and staff name, newest first.

    ``advance_paid``, ``balance`` and ``payment_date`` are the stored columns,
    as they stand (see ``quality.reconcile_bookings`` for how they compare).
    For bookings stored without them, ``balances`` (id, paid, balance) gives the
    payment roll-up instead.
    """
    b = conform_entity(bookings, "bookings")
    if balances is not None:
        bal = balances.select(F.col("id").alias("_bid"), F.col("paid").alias("advance_paid"), "balance")
        b = b.drop("advance_paid", "balance").join(bal, b["id"] == bal["_bid"], "left")
    lk = leads.select(F.col("id").alias("_lid"), "customer_name", "mobile", "tour_name", "travel_date")
    b = b.join(lk, b["lead_id"] == lk["_lid"], "left")
    b = with_user_name(b, users, "user_id", "staff")
    return (b.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
            .select(*BOOKING_EXPORT_COLUMNS))


def resolve_by_name(staged: DataFrame, dim: DataFrame, staged_col: str, out_col: str,
                    dim_name: str = "name", dim_id: str = "id") -> DataFrame:
    """Replace a looked-up name by the dimension id (equi-join).

    A name that matches no row gives NULL; a name shared by several rows is
    ambiguous (a scalar sub-query would fail) and also gives NULL, with the
    reason in ``resolve_issue``.
    """
    names = (dim.groupBy(F.col(dim_name).alias("_n"))
             .agg(F.min(dim_id).alias("_id"), F.count(F.lit(1)).alias("_k")))
    j = staged.join(names, staged[staged_col] == names["_n"], "left")
    issue = F.when(F.col("_n").isNull(), "unknown").when(F.col("_k") > 1, "ambiguous")
    return (j.withColumn(out_col, F.when(F.col("_k") == 1, F.col("_id")))
            .withColumn("resolve_issue", issue).drop("_n", "_id", "_k"))
