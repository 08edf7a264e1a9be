"""Typed JSON columns of the packages table.

Shapes follow the stored documents.  Unparsable text or NULL falls back to
an empty list (or an all-NULL object for ``transport``), as the detail page
does; the raw text is kept beside the parsed value where callers need it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY10 = T.DecimalType(10, 2)

ITINERARY = T.ArrayType(T.StructType([
    T.StructField("day", T.IntegerType()),
    T.StructField("description", T.StringType()),
]))
HOTELS = T.ArrayType(T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("price", MONEY10),
    T.StructField("nights", T.IntegerType()),
]))
TRANSPORT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("price", MONEY10),
])
OTHER_CHARGES = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("amount", MONEY10),
]))

SCHEMAS = {"itinerary": ITINERARY, "hotels": HOTELS, "transport": TRANSPORT,
           "other_charges": OTHER_CHARGES}


def parse(col_name: str) -> Column:
    """``from_json`` with the typed fallback (malformed text parses to NULL)."""
    schema = SCHEMAS[col_name]
    parsed = F.from_json(F.col(col_name), schema)
    if isinstance(schema, T.ArrayType):
        return F.coalesce(parsed, F.array().cast(schema))
    return F.coalesce(parsed, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name)
                                         for f in schema.fields]))


def decode(col_name: str) -> Column:
    """The decoded member or, where its text is no JSON, the text itself: struct(value variant, raw, failed).

    Any JSON value is taken, whatever its shape.  NULL and empty texts are left as
    they are: no value, not failed, ``raw`` as stored.  ``raw`` is NULL beside a value.
    """
    text = F.col(col_name)
    given = F.coalesce(text != "", F.lit(False))
    value = F.try_parse_json(text)
    return F.struct(F.when(given, value).alias("value"), F.when(~given | value.isNull(), text).alias("raw"),
                    (given & value.isNull()).alias("failed"))


def is_valid_json(col_name: str) -> Column:
    """True when the text parses as the column's shape, NULL for NULL input."""
    return F.when(F.col(col_name).isNull(), F.lit(None).cast("boolean")).otherwise(
        F.from_json(F.col(col_name), SCHEMAS[col_name]).isNotNull())


def money_total(arr: Column, amount) -> Column:
    """Σ amount(x) over an array as decimal(18,2); NULL items count 0."""
    zero = F.lit(0).cast("decimal(18,2)")
    return F.aggregate(arr, zero,
                       lambda acc, x: (acc + F.coalesce(amount(x), F.lit(0))).cast("decimal(18,2)"))
