"""Year-sequenced business codes: last / max code per year, batch numbering.

Numbering a batch ("the n-th new lead of 2001") needs each row's position
within its year.  A plain ``row_number()`` over ``partitionBy(year)`` would
send a whole year to one task, so positions come from
``wayline.operators.sequence.position_within`` (bounded blocks plus running
block offsets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.codes import BOOKING_CODE_RE, code_suffix, code_year, format_code
from wayline.operators.sequence import position_within

__all__ = ["assign_codes", "booking_code_max", "lead_code_last", "position_within"]


def booking_code_max(bookings: DataFrame) -> DataFrame:
    """Per year, the largest 5-digit suffix among well-formed codes.

    Codes whose number grew past 99999 no longer match the pattern, so the
    maximum sticks there (as in the reference numbering).
    """
    ok = bookings.where(F.col("booking_id").rlike(BOOKING_CODE_RE))
    return (ok.groupBy(code_year(F.col("booking_id")).alias("year"))
            .agg(F.max(code_suffix(F.col("booking_id"))).alias("max_seq")))


def lead_code_last(leads: DataFrame) -> DataFrame:
    """Per year, the code of the highest row id and its numeric suffix."""
    with_year = leads.where(F.col("lead_id").startswith("LEAD-")).withColumn(
        "year", code_year(F.col("lead_id")))
    last = (with_year.where(F.col("year").isNotNull()).groupBy("year")
            .agg(F.max_by("lead_id", "id").alias("last_code")))
    return last.select("year", "last_code", code_suffix(F.col("last_code")).alias("last_seq"))


def assign_codes(requests: DataFrame, base: DataFrame, prefix: str, year: Column,
                 order_col: str, out_col: str) -> DataFrame:
    """code = base number of the year + position of the request in its year.

    ``base`` has columns (year, last_seq); a year absent from it starts at 0.
    """
    r = requests.withColumn("_year", year.cast("int"))
    r = position_within(r, "_year", order_col, "_pos")
    b = base.select(F.col("year").alias("_by"), F.col("last_seq").alias("_base"))
    r = r.join(b, r["_year"] == b["_by"], "left")
    seq = F.coalesce(F.col("_base"), F.lit(0)) + F.col("_pos")
    return (r.withColumn(out_col, format_code(prefix, F.col("_year"), seq))
            .withColumn(f"{out_col}_seq", seq.cast("bigint"))
            .drop("_year", "_pos", "_by", "_base"))
