"""Date and time helpers.  ``as_of`` is always an explicit parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (the driver tables store NTZ timestamps)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp_ntz")


def date_lit(value: str | dt.date) -> Column:
    if isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(value).cast("date")


def months_before(as_of: str, months: int) -> Column:
    """``as_of - INTERVAL n MONTHS`` kept as a timestamp (not a date)."""
    return ts_lit(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))


def same_day(ts_col: Column, day: str) -> Column:
    """``DATE(ts) = day``; Spark rewrites it into a pushable range."""
    return F.to_date(ts_col) == date_lit(day)


def followup_bucket(day_col: Column, today: str) -> Column:
    """today / tomorrow / overdue (before today) / upcoming (after tomorrow)."""
    d0 = date_lit(today)
    return (F.when(day_col < d0, "overdue")
             .when(day_col == d0, "today")
             .when(day_col == F.date_add(d0, 1), "tomorrow")
             .otherwise("upcoming"))


def bucket_predicate(day_col: Column, today: str, bucket: str | None) -> Column:
    """Filter for one follow-up tab; an unknown tab keeps all rows."""
    d0 = date_lit(today)
    if bucket == "today":
        return day_col == d0
    if bucket == "tomorrow":
        return day_col == F.date_add(d0, 1)
    if bucket == "overdue":
        return day_col < d0
    if bucket == "upcoming":
        return day_col > F.date_add(d0, 1)
    return F.lit(True)


def age_label(ts_col: Column, as_of: str) -> Column:
    """Minutes under an hour, hours under a day, else days (all floored).

    Differences are taken in whole milliseconds, as a browser clock does.
    """
    now_ms = F.unix_micros(ts_lit(as_of).cast("timestamp")) / 1000
    then_ms = F.floor(F.unix_micros(ts_col.cast("timestamp")) / 1000)
    mins = F.floor((now_ms - then_ms) / 60000)
    hrs = F.floor(mins / 60)
    return (F.when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
             .when(hrs < 24, F.concat(hrs.cast("string"), F.lit("h ago")))
             .otherwise(F.concat(F.floor(hrs / 24).cast("string"), F.lit("d ago"))))


def month_key(ts_col: Column) -> Column:
    return F.date_format(ts_col, "yyyy-MM")
