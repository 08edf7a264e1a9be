"""Registered source / sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators import exports as X
from wayline.operators import reports as R
from wayline.plans.registry import register
from wayline.session import scratch_path
from wayline.sources import io
from wayline.sources.schemas import DEFAULTS, LEADS


@register("scan_leads", family="sources", oracle="SELECT * FROM crm_leads")
def scan_leads(t):
    """The leads table read with its declared types."""
    return io.conform_entity(t.leads, "leads", only_present=True)


_DUCK_TYPES = {"StringType()": "VARCHAR", "LongType()": "BIGINT", "IntegerType()": "INTEGER",
               "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP"}


def _default_sql(name: str) -> str:
    """Oracle text of an absent column: its default, typed like the schema."""
    v = DEFAULTS["leads"].get(name)
    typ = _DUCK_TYPES[repr(LEADS[name].dataType)]
    lit = "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))
    return f"CAST({lit} AS {typ})"


_ABSENT = [f.name for f in LEADS.fields if f.name not in {
    "id", "lead_id", "customer_name", "mobile", "alt_mobile", "city", "tour_name", "travel_date",
    "adults", "children", "hotel_category", "lead_source", "assigned_to", "status", "enquiry_date",
    "created_at", "is_deleted", "deleted_at", "deleted_by", "tour_category_id", "tour_subcategory_id"}]


@register("conform_schema", family="sources", oracle="SELECT *, " + ", ".join(
    f"{_default_sql(c)} AS {c}" for c in _ABSENT) + " FROM crm_leads")
def conform_schema(t):
    """Leads with every declared column; missing ones get their default."""
    return io.conform_entity(t.leads, "leads")


@register("load_typed", family="sources", oracle="SELECT *, CAST(NULL AS VARCHAR) AS _corrupt_record FROM crm_leads")
def load_typed(t):
    """Leads exported to CSV in the shared scratch folder, loaded back
    with the declared schema in PERMISSIVE mode (corrupt rows kept apart)."""
    typed = io.conform_entity(t.leads, "leads", only_present=True)
    path = scratch_path(t.spark, "load-typed")
    io.write_csv(typed, path)
    schema = T.StructType([f for f in LEADS.fields if f.name in typed.columns])
    schema = T.StructType([schema[c] for c in typed.columns])
    return io.load_typed(t.spark, path, schema, "csv")


@register("export_leads", family="sources", oracle="""
SELECT l.lead_id, l.customer_name, l.mobile, l.alt_mobile, CAST(NULL AS VARCHAR) AS email, l.city, l.tour_name,
       l.travel_date, l.adults, l.children, l.hotel_category, 'MAP' AS meal_plan,
       'Sedan' AS vehicle_type, l.lead_source, l.status, l.enquiry_date,
       u.full_name AS assigned_to, l.created_at
FROM crm_leads l LEFT JOIN crm_users u ON l.assigned_to = u.id""")
def export_leads(t):
    return X.export_leads(t.leads, t.users)


@register("export_bookings", family="sources", oracle="""
SELECT b.booking_id, l.customer_name, l.mobile, l.tour_name, l.travel_date,
       b.total_amount, b.discount, b.final_amount,
       CAST(COALESCE(p.paid, 0) AS DECIMAL(18,2)) AS advance_paid,
       CAST(b.final_amount - COALESCE(p.paid, 0) AS DECIMAL(18,2)) AS balance,
       b.payment_method, CAST(NULL AS DATE) AS payment_date, u.full_name AS staff, b.created_at
FROM crm_bookings b
LEFT JOIN crm_leads l ON b.lead_id = l.id
LEFT JOIN crm_users u ON b.user_id = u.id
LEFT JOIN (SELECT booking_id, SUM(amount) AS paid FROM crm_payments GROUP BY booking_id) p
  ON p.booking_id = b.id""")
def export_bookings(t):
    return X.export_bookings(t.bookings, t.leads, t.users, R.booking_balances(t.bookings, t.payments))


@register("seed_resolve_fk", family="sources", oracle="""
SELECT s.sub_name, s.category_name, c.id AS category_id,
       CASE WHEN c.id IS NULL THEN 'unknown' END AS resolve_issue
FROM (SELECT n_name AS sub_name, r_name AS category_name
      FROM nation JOIN region ON n_regionkey = r_regionkey) s
LEFT JOIN crm_tour_categories c ON c.name = s.category_name""")
def seed_resolve_fk(t):
    """Staged sub-categories name their category; resolve it to its id."""
    staged = (t.base("nation").join(t.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("n_name").alias("sub_name"), F.col("r_name").alias("category_name")))
    return X.resolve_by_name(staged, t.tour_categories, "category_name", "category_id")
