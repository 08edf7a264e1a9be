"""Display-derived columns computed as data (labels, initials, ages, flags)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.dates import age_label, date_lit

# Fixed value: the mobile format the lead form accepts (10 digits, 6-9 first).
MOBILE_RE = r"^[6-9][0-9]{9}$"


def activity_labels(activity: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Action label, actor initial and display name, age label."""
    names = users.select(F.col("id").alias("_u"), "full_name")
    a = activity.join(names, activity["user_id"] == names["_u"], "left").drop("_u")
    nonempty = F.when(F.col("full_name") != "", F.col("full_name"))
    return a.select(
        "id",
        F.regexp_replace("action", "_", " ").alias("action_label"),
        F.substring(F.coalesce(nonempty, F.lit("?")), 1, 1).alias("initial"),
        F.coalesce(nonempty, F.lit("System")).alias("actor"),
        age_label(F.col("created_at"), as_of).alias("age"))


def subcategory_labels(subcategories: DataFrame) -> DataFrame:
    """``<nights>N/<days>D`` when days are set (missing nights print 'null')."""
    days_set = F.coalesce(F.col("duration_days"), F.lit(0)) != 0
    label = F.concat(F.coalesce(F.col("duration_nights").cast("string"), F.lit("null")),
                     F.lit("N/"), F.col("duration_days").cast("string"), F.lit("D"))
    return subcategories.select(
        "id", "name",
        F.when(days_set, label).alias("duration_label"),
        F.when(F.col("is_active") == 1, "Active").otherwise("Inactive").alias("state"))


def lead_display(leads: DataFrame, as_of_day: str) -> DataFrame:
    """Mobile format check, travel-date-passed flag, shown date."""
    return leads.select(
        "id",
        F.coalesce(F.col("mobile").rlike(MOBILE_RE), F.lit(False)).alias("mobile_ok"),
        F.col("alt_mobile").rlike(MOBILE_RE).alias("alt_mobile_ok"),
        (F.col("travel_date") < date_lit(as_of_day)).alias("travel_passed"),
        F.coalesce(F.col("enquiry_date"), F.to_date("created_at")).alias("shown_date"))
