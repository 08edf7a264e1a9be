"""Business-code helpers: ``LEAD-<year>-<n>`` and ``BOOKING-<year>-<n>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes and the strict booking-code shape.
LEAD_PREFIX = "LEAD"
BOOKING_PREFIX = "BOOKING"
BOOKING_CODE_RE = r"^BOOKING-[0-9]{4}-[0-9]{5}$"


def format_code(prefix: str, year: Column, seq: Column) -> Column:
    """``PREFIX-year-%05d``; numbers past 99999 keep all their digits."""
    return F.format_string(f"{prefix}-%d-%05d", year.cast("int"), seq.cast("bigint"))


def code_suffix(code: Column) -> Column:
    """Numeric part after the last ``-``; NULL when it is not a number."""
    return F.substring_index(code, "-", -1).try_cast("bigint")


def code_year(code: Column) -> Column:
    """The year field of a code (second dash-separated part)."""
    return F.split_part(code, F.lit("-"), F.lit(2)).try_cast("int")
