"""Money and ratio helpers.

Money stays decimal end to end (never summed as double).  Ratios shown as
whole percents use half-up rounding toward +infinity, as the report pages do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(col: Column) -> Column:
    return col.cast(MONEY)


def money_sum(col: Column) -> Column:
    return F.sum(col).cast(MONEY)


def round_half_up_ratio(num: Column, den: Column, scale: int = 1) -> Column:
    """floor(scale * num / den + 1/2) as BIGINT, 0 when ``den`` is 0 or NULL.

    Written as floor((2*scale*num + den) / (2*den)) so both factors are exact
    integers before the one division.
    """
    n = num.cast("bigint")
    d = den.cast("bigint")
    val = F.floor((F.lit(2 * scale) * n + d) / (F.lit(2) * d)).cast("bigint")
    return F.when(d > 0, val).otherwise(F.lit(0).cast("bigint"))


def percent(num: Column, den: Column) -> Column:
    return round_half_up_ratio(num, den, 100)


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def average_rounded(total_amount: Column, count: Column) -> Column:
    """Whole-unit average of a money total, half-up; 0 when count is 0."""
    c = count.cast("bigint")
    val = F.floor((F.lit(2) * cents(total_amount) + F.lit(100) * c) / (F.lit(200) * c)).cast("bigint")
    return F.when(c > 0, val).otherwise(F.lit(0).cast("bigint"))


def rate_band(rate: Column) -> Column:
    return F.when(rate > 50, "high").when(rate > 25, "medium").otherwise("low")
