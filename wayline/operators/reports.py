"""Dashboards, scorecards and trends (aggregations over whole tables).

Shape rule used throughout: aggregate each fact table on its join key first
(partial aggregation runs map-side, so a hot key is collapsed before the
shuffle), then join the small aggregated results to the user / category
dimension.  No fact-to-fact join happens, so nothing fans out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.dates import date_lit, followup_bucket, month_key, months_before
from wayline.functions.numbers import MONEY, average_rounded, cents, money_sum, percent, rate_band

LEAD_STATUSES = ("New Lead", "Follow-up", "Negotiation", "Booked", "Lost")


def _staff(users: DataFrame, active_only: bool = True) -> DataFrame:
    cond = F.col("role") == "staff"
    if active_only:
        cond = cond & (F.col("is_active") == 1)
    return users.where(cond)


def lead_counts_by_assignee(leads: DataFrame) -> DataFrame:
    return (leads.groupBy(F.col("assigned_to").alias("uid"))
            .agg(F.count(F.lit(1)).alias("total_leads"),
                 F.count_if(F.col("status") == "New Lead").alias("new_leads"),
                 F.count_if(F.col("status") == "Booked").alias("converted"),
                 F.count_if(F.col("status") == "Lost").alias("lost")))


def calls_by_user(conversations: DataFrame) -> DataFrame:
    return (conversations.groupBy(F.col("user_id").alias("uid"))
            .agg(F.count(F.lit(1)).alias("total_calls")))


def revenue_by_user(bookings: DataFrame) -> DataFrame:
    """Bookings and Σ final_amount per user."""
    return (bookings.groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("bookings"),
                 money_sum(F.col("final_amount")).alias("revenue")))


def staff_performance(users: DataFrame, leads: DataFrame, conversations: DataFrame,
                      bookings: DataFrame) -> DataFrame:
    """Scorecard of active staff; zero rows for staff with no activity.

    Leads count by ``assigned_to``; calls and bookings by ``user_id``.
    Soft-deleted leads are included.  Sorted by revenue, highest first.
    """
    la = lead_counts_by_assignee(leads)
    ca = calls_by_user(conversations)
    ba = revenue_by_user(bookings).withColumnRenamed("user_id", "uid")
    u = _staff(users).select("id", "full_name", "username")
    out = (u.join(la, u["id"] == la["uid"], "left").drop("uid")
            .join(ca, u["id"] == ca["uid"], "left").drop("uid")
            .join(ba, u["id"] == ba["uid"], "left").drop("uid"))
    zero = F.lit(0).cast("bigint")
    return (out.select(
        "id", "full_name", "username",
        F.coalesce("total_leads", zero).alias("total_leads"),
        F.coalesce("new_leads", zero).alias("new_leads"),
        F.coalesce("converted", zero).alias("converted"),
        F.coalesce("lost", zero).alias("lost"),
        F.coalesce("total_calls", zero).alias("total_calls"),
        F.coalesce("bookings", zero).alias("bookings"),
        F.coalesce("revenue", F.lit(0).cast(MONEY)).alias("revenue"))
        .orderBy(F.desc("revenue"), F.asc("id")))


def dashboard_staff_table(users: DataFrame, leads: DataFrame, conversations: DataFrame,
                          bookings: DataFrame) -> DataFrame:
    """The dashboard's short staff table (no converted/lost columns)."""
    return staff_performance(users, leads, conversations, bookings).select(
        "id", "full_name", F.col("total_leads").alias("leads"),
        F.col("total_calls").alias("calls"), "bookings", "revenue")


def staff_rates(perf: DataFrame) -> DataFrame:
    """Conversion rate %, band and whole-unit average ticket."""
    rate = percent(F.col("converted"), F.col("total_leads"))
    return perf.select(
        "id", "full_name", "total_leads", "converted", "bookings", "revenue",
        rate.alias("conversion_pct"),
        rate_band(rate).alias("rate_band"),
        average_rounded(F.col("revenue"), F.col("bookings")).alias("avg_ticket"))


def _tagged_facts(leads: DataFrame, followups: DataFrame, bookings: DataFrame,
                  lead_user: str, fu_user: str, bk_user: str) -> DataFrame:
    """One narrow stream of the three fact tables, tagged by kind."""
    null_money = F.lit(None).cast(MONEY)
    parts = [
        leads.select(F.lit("lead").alias("kind"), F.col(lead_user).alias("uid"),
                     F.to_date("created_at").alias("day"), "status",
                     null_money.alias("amount")),
        followups.select(F.lit("followup").alias("kind"), F.col(fu_user).alias("uid"),
                         F.col("followup_date").alias("day"), "status",
                         null_money.alias("amount")),
        bookings.select(F.lit("booking").alias("kind"), F.col(bk_user).alias("uid"),
                        F.to_date("created_at").alias("day"),
                        F.lit(None).cast("string").alias("status"),
                        F.col("final_amount").cast(MONEY).alias("amount")),
    ]
    return reduce(DataFrame.unionByName, parts)


def dashboard_kpis(leads: DataFrame, followups: DataFrame, bookings: DataFrame,
                   as_of: str, followup_as_of: str | None = None) -> DataFrame:
    """A2: the eight admin KPIs in one pass (one global aggregate, no joins)."""
    d0 = date_lit(as_of[:10])
    f0 = date_lit((followup_as_of or as_of)[:10])
    facts = _tagged_facts(leads, followups, bookings, "assigned_to", "user_id", "user_id")
    k = F.col("kind")
    pending = (k == "followup") & (F.col("status") == "Pending")
    zero = F.lit(0).cast(MONEY)
    return facts.agg(
        F.count_if(k == "lead").alias("total_leads"),
        F.count_if((k == "lead") & (F.col("day") == d0)).alias("new_leads_today"),
        F.count_if(pending & (F.col("day") == f0)).alias("followups_today"),
        F.count_if(pending & (F.col("day") < f0)).alias("overdue"),
        F.count_if((k == "booking") & (F.col("day") == d0)).alias("bookings_today"),
        F.count_if(k == "booking").alias("total_bookings"),
        F.coalesce(money_sum(F.when((k == "booking") & (F.col("day") == d0), F.col("amount"))),
                   zero).alias("revenue_today"),
        F.coalesce(money_sum(F.when(k == "booking", F.col("amount"))), zero).alias("total_revenue"),
    )


def dashboard_staff_kpis(users: DataFrame, leads: DataFrame, followups: DataFrame,
                         bookings: DataFrame, followup_as_of: str) -> DataFrame:
    """A3: every staff member's personal KPI set, computed for all at once."""
    f0 = date_lit(followup_as_of[:10])
    facts = _tagged_facts(leads, followups, bookings, "assigned_to", "user_id", "user_id")
    k = F.col("kind")
    pending = (k == "followup") & (F.col("status") == "Pending")
    per_user = (facts.where(F.col("uid").isNotNull()).groupBy("uid").agg(
        F.count_if(k == "lead").alias("my_leads"),
        F.count_if((k == "lead") & (F.col("status") == "New Lead")).alias("new_leads"),
        F.count_if(pending & (F.col("day") == f0)).alias("followups_today"),
        F.count_if(pending & (F.col("day") < f0)).alias("overdue"),
        F.count_if(k == "booking").alias("bookings"),
        money_sum(F.when(k == "booking", F.col("amount"))).alias("revenue")))
    u = _staff(users, active_only=False).select(F.col("id").alias("user_id"))
    zero = F.lit(0).cast("bigint")
    out = u.join(per_user, u["user_id"] == per_user["uid"], "left")
    return out.select(
        "user_id",
        *[F.coalesce(c, zero).alias(c) for c in
          ("my_leads", "new_leads", "followups_today", "overdue", "bookings")],
        F.coalesce("revenue", F.lit(0).cast(MONEY)).alias("revenue"))


def lead_status_counts(leads: DataFrame) -> DataFrame:
    """A4."""
    return leads.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


def lead_status_share(leads: DataFrame) -> DataFrame:
    """A18 + W2: count, whole-percent share of all leads and bar width vs max.

    The un-keyed window runs over the handful of aggregated status rows
    only (one row per status value), so its single task is tiny; it beats
    scalar sub-queries, which add jobs and may repeat the aggregate.
    """
    counts = lead_status_counts(leads)
    w = Window.partitionBy()
    total = F.sum("cnt").over(w)
    return counts.select(
        "status", "cnt",
        percent(F.col("cnt"), total).alias("pct"),
        percent(F.col("cnt"), F.max("cnt").over(w)).alias("bar_pct"))


def conversion_rate(leads: DataFrame) -> DataFrame:
    """Booked leads over all leads, whole percent."""
    agg = leads.agg(F.count(F.lit(1)).alias("total_leads"),
                    F.count_if(F.col("status") == "Booked").alias("booked"))
    return agg.select("total_leads", "booked",
                      percent(F.col("booked"), F.col("total_leads")).alias("conversion_pct"))


def monthly_bookings(bookings: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Bookings and revenue per calendar month over a rolling window.

    The window starts ``months`` before ``as_of`` (mid-month), so the first
    month is partial; months without bookings are absent.
    """
    return (bookings.where(F.col("created_at") >= months_before(as_of, months))
            .groupBy(month_key(F.col("created_at")).alias("month"))
            .agg(F.count(F.lit(1)).alias("bookings"),
                 F.sum("final_amount").cast(MONEY).alias("revenue"))
            .orderBy("month"))


def monthly_bookings_bar(bookings: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Each month's revenue as a whole percent of the best month.

    The un-keyed window sees only the aggregated month rows (at most
    ``months`` + 1), never the bookings themselves.
    """
    m = monthly_bookings(bookings, as_of, months)
    best = F.max("revenue").over(Window.partitionBy())
    return m.select("month", "bookings", "revenue",
                    percent(cents(F.col("revenue")), cents(best)).alias("bar_pct"))


def followup_bucket_counts(followups: DataFrame, today: str) -> DataFrame:
    """Pending follow-ups per tab (today, tomorrow, overdue, upcoming)."""
    return (followups.where(F.col("status") == "Pending")
            .groupBy(followup_bucket(F.col("followup_date"), today).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def category_stats(categories: DataFrame, subcategories: DataFrame,
                   leads: DataFrame) -> DataFrame:
    """Per category, active sub-categories and leads pointing to it.

    The reference joins categories x sub-categories x leads and undoes the
    fan-out with COUNT DISTINCT; here each side is counted on its own key
    first (ids are primary keys) and the counts are joined, so no fan-out.
    """
    subs = (subcategories.where(F.col("is_active") == 1)
            .groupBy(F.col("category_id").alias("cid"))
            .agg(F.count_distinct("id").alias("subcat_count")))
    lc = (leads.where(F.col("tour_category_id").isNotNull())
          .groupBy(F.col("tour_category_id").alias("lcid"))
          .agg(F.count(F.lit(1)).alias("lead_count")))
    out = (categories.join(subs, categories["id"] == subs["cid"], "left")
           .join(lc, categories["id"] == lc["lcid"], "left"))
    zero = F.lit(0).cast("bigint")
    return (out.select(
        categories["id"], categories["name"], categories["sort_order"], categories["is_active"],
        F.coalesce("subcat_count", zero).alias("subcat_count"),
        F.coalesce("lead_count", zero).alias("lead_count"))
        .orderBy(F.asc_nulls_first("sort_order"), F.asc_nulls_first("name")))


def category_totals(stats: DataFrame, subcategories: DataFrame) -> DataFrame:
    """Category page totals.

    The sub-category total counts every listed sub-category, inactive ones
    included (the page sums the nested lists, not the active counts).
    """
    per_cat = (subcategories.groupBy(F.col("category_id").alias("cid"))
               .agg(F.count(F.lit(1)).alias("n_all")))
    s = stats.join(per_cat, stats["id"] == per_cat["cid"], "left")
    return s.agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(F.col("is_active") == 1).alias("active_categories"),
        F.coalesce(F.sum("n_all"), F.lit(0)).cast("bigint").alias("subcategories"),
        F.coalesce(F.sum("lead_count"), F.lit(0)).cast("bigint").alias("leads"))


def booking_balances(bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """Σ payments per booking and balance = final − paid (may go negative)."""
    paid = (payments.groupBy(F.col("booking_id").alias("bid"))
            .agg(F.sum("amount").cast(MONEY).alias("paid")))
    b = bookings.select("id", "booking_id", "final_amount")
    out = b.join(paid, b["id"] == paid["bid"], "left")
    paid_c = F.coalesce(F.col("paid"), F.lit(0).cast(MONEY))
    return out.select("id", "booking_id",
                      F.col("final_amount").cast(MONEY).alias("final_amount"),
                      paid_c.alias("paid"),
                      (F.col("final_amount") - paid_c).cast(MONEY).alias("balance"))


def booking_payment_state(balances: DataFrame) -> DataFrame:
    """'Due' while a balance is left, else 'Paid' (overpaid shows Paid)."""
    return balances.select("id", "balance",
                           F.when(F.col("balance") > 0, "Due").otherwise("Paid").alias("state"))


def leads_per_year(leads: DataFrame) -> DataFrame:
    """Leads created per calendar year."""
    return (leads.groupBy(F.year("created_at").alias("year"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def leads_live_count(leads: DataFrame) -> DataFrame:
    """live and trashed lead counts."""
    return leads.agg(F.count_if(F.col("is_deleted") == 0).alias("live"),
                     F.count_if(F.col("is_deleted") == 1).alias("trashed"))
