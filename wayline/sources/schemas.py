"""Declared schemas of the CRM entities (no inference anywhere).

Ids are LongType (the driver tables store 64-bit keys); flags are 0/1 ints;
money is decimal(10,2); ``timestamp`` columns are TIMESTAMP_NTZ like the
driver's Parquet.  ``DEFAULTS`` holds the column defaults used when a column
is absent (schema evolution by "add column if missing").
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, D, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType()
M = T.DecimalType(10, 2)


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


USERS = _st(("id", L), ("username", S), ("full_name", S), ("email", S), ("phone", S),
            ("role", S), ("is_active", I), ("created_at", TS), ("updated_at", TS))

LEADS = _st(("id", L), ("lead_id", S), ("customer_name", S), ("mobile", S), ("alt_mobile", S),
            ("email", S), ("city", S), ("tour_name", S), ("travel_date", D),
            ("pickup_location", S), ("drop_location", S), ("adults", I), ("children", I),
            ("hotel_category", S), ("meal_plan", S), ("vehicle_type", S), ("lead_source", S),
            ("assigned_to", L), ("status", S), ("enquiry_date", D), ("notes", S),
            ("created_at", TS), ("updated_at", TS), ("tour_category_id", L),
            ("tour_subcategory_id", L), ("is_deleted", I), ("deleted_at", TS), ("deleted_by", L))

CONVERSATIONS = _st(("id", L), ("lead_id", L), ("user_id", L), ("summary", S), ("call_result", S),
                    ("call_type", S), ("next_followup_date", D), ("call_duration", I),
                    ("created_at", TS))

FOLLOWUPS = _st(("id", L), ("lead_id", L), ("user_id", L), ("followup_date", D), ("notes", S),
                ("status", S), ("completed_at", TS), ("created_at", TS))

PACKAGES = _st(("id", L), ("lead_id", L), ("user_id", L), ("tour_name", S), ("itinerary", S),
               ("hotels", S), ("transport", S), ("other_charges", S), ("base_price", M),
               ("discount", M), ("final_price", M), ("notes", S), ("created_at", TS),
               ("updated_at", TS))

BOOKINGS = _st(("id", L), ("booking_id", S), ("lead_id", L), ("user_id", L), ("total_amount", M),
               ("discount", M), ("final_amount", M), ("advance_paid", M), ("balance", M),
               ("payment_method", S), ("payment_date", D), ("notes", S), ("created_at", TS),
               ("updated_at", TS))

PAYMENTS = _st(("id", L), ("booking_id", L), ("amount", M), ("payment_method", S),
               ("payment_date", D), ("reference_no", S), ("notes", S), ("created_at", TS))

ACTIVITY_LOGS = _st(("id", L), ("user_id", L), ("action", S), ("entity_type", S),
                    ("entity_id", L), ("details", S), ("created_at", TS))

WHATSAPP_LOGS = _st(("id", L), ("lead_id", L), ("user_id", L), ("message", S), ("created_at", TS))

LEAD_NOTES = _st(("id", L), ("lead_id", L), ("user_id", L), ("note", S), ("color", S),
                 ("created_at", TS))

LEAD_ASSIGNMENTS = _st(("id", L), ("lead_id", L), ("assigned_from", L), ("assigned_to", L),
                       ("assigned_by", L), ("notes", S), ("created_at", TS))

TOUR_CATEGORIES = _st(("id", L), ("name", S), ("description", S), ("icon", S), ("color", S),
                      ("sort_order", I), ("is_active", I), ("created_at", TS), ("updated_at", TS))

TOUR_SUBCATEGORIES = _st(("id", L), ("category_id", L), ("name", S), ("description", S),
                         ("duration_days", I), ("duration_nights", I), ("starting_price", M),
                         ("tags", S), ("sort_order", I), ("is_active", I), ("created_at", TS),
                         ("updated_at", TS))

SCHEMAS = {
    "users": USERS, "leads": LEADS, "conversations": CONVERSATIONS, "followups": FOLLOWUPS,
    "packages": PACKAGES, "bookings": BOOKINGS, "payments": PAYMENTS,
    "activity_logs": ACTIVITY_LOGS, "whatsapp_logs": WHATSAPP_LOGS, "lead_notes": LEAD_NOTES,
    "lead_assignments": LEAD_ASSIGNMENTS, "tour_categories": TOUR_CATEGORIES,
    "tour_subcategories": TOUR_SUBCATEGORIES,
}

# Column defaults of the reference tables.
DEFAULTS = {
    "users": {"role": "staff", "is_active": 1},
    "leads": {"adults": 1, "children": 0, "hotel_category": "Budget", "meal_plan": "MAP",
              "vehicle_type": "Sedan", "lead_source": "Call", "status": "New Lead",
              "is_deleted": 0},
    "conversations": {"call_result": "Other", "call_type": "Outgoing"},
    "followups": {"status": "Pending"},
    "packages": {"base_price": 0, "discount": 0, "final_price": 0},
    "bookings": {"discount": 0, "advance_paid": 0, "balance": 0, "payment_method": "Cash"},
    "payments": {"payment_method": "Cash", "reference_no": ""},
    "lead_notes": {"color": "yellow"},
    "tour_categories": {"icon": "fa-map-marked-alt", "color": "#F97316", "sort_order": 0,
                        "is_active": 1},
    "tour_subcategories": {"tags": "", "sort_order": 0, "is_active": 1},
}
