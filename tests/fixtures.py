"""Small invented tables in the CRM view shapes (no reference data copied)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

USERS_DDL = "id BIGINT, username STRING, full_name STRING, role STRING, is_active INT"
LEADS_DDL = ("id BIGINT, lead_id STRING, customer_name STRING, mobile STRING, alt_mobile STRING, "
             "city STRING, tour_name STRING, travel_date DATE, adults INT, children INT, "
             "hotel_category STRING, lead_source STRING, assigned_to BIGINT, status STRING, "
             "enquiry_date DATE, created_at TIMESTAMP_NTZ, is_deleted INT, "
             "deleted_at TIMESTAMP_NTZ, deleted_by BIGINT, tour_category_id BIGINT, "
             "tour_subcategory_id BIGINT")
CONV_DDL = ("id BIGINT, lead_id BIGINT, user_id BIGINT, call_result STRING, call_type STRING, "
            "next_followup_date DATE, call_duration INT, created_at TIMESTAMP_NTZ")
BOOKINGS_DDL = ("id BIGINT, booking_id STRING, lead_id BIGINT, user_id BIGINT, "
                "total_amount DECIMAL(10,2), discount DECIMAL(10,2), final_amount DECIMAL(10,2), "
                "payment_method STRING, created_at TIMESTAMP_NTZ")
PAYMENTS_DDL = "booking_id BIGINT, amount DECIMAL(10,2), payment_method STRING, payment_date DATE"
FOLLOWUPS_DDL = ("id BIGINT, lead_id BIGINT, user_id BIGINT, followup_date DATE, status STRING, "
                 "created_at TIMESTAMP_NTZ")
PACKAGES_DDL = ("id BIGINT, lead_id BIGINT, user_id BIGINT, tour_name STRING, itinerary STRING, "
                "hotels STRING, transport STRING, other_charges STRING, base_price DECIMAL(10,2), "
                "discount DECIMAL(10,2)")
CATS_DDL = "id BIGINT, name STRING, sort_order INT, is_active INT"
SUBS_DDL = ("id BIGINT, category_id BIGINT, name STRING, duration_days INT, duration_nights INT, "
            "starting_price DECIMAL(10,2), tags STRING, sort_order INT, is_active INT")
ASSIGN_DDL = ("id BIGINT, lead_id BIGINT, assigned_from BIGINT, assigned_to BIGINT, "
              "assigned_by BIGINT, created_at TIMESTAMP_NTZ")

T0 = dt.datetime(2026, 3, 10, 9, 0, 0)


def ts(day: int, hour: int = 9) -> dt.datetime:
    return dt.datetime(2026, 3, day, hour, 0, 0)


def lead(id_, status="New Lead", assigned=2, mobile="9000000001", created=None, deleted=0,
         cat=None, name=None):
    created = created or T0
    return (id_, f"LEAD-2026-{id_:05d}", name or f"Cust {id_}", mobile, None, "Town", "Tour X",
            dt.date(2026, 4, 1), 1, 0, "Budget", "Call", assigned, status, created.date(), created,
            deleted, None, None, cat, None)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def df(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)
