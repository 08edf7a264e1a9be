"""Package documents: typed JSON parsing, price checks, itinerary rows, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import jsonpkg as J


def parsed_packages(packages: DataFrame) -> DataFrame:
    """Typed JSON members beside the raw text (kept for bad input)."""
    return packages.select(
        "*",
        J.parse("itinerary").alias("itinerary_v"),
        J.parse("hotels").alias("hotels_v"),
        J.parse("transport").alias("transport_v"),
        J.parse("other_charges").alias("other_charges_v"),
        J.is_valid_json("hotels").alias("hotels_ok"))


def package_members(packages: DataFrame) -> DataFrame:
    """One row per package and JSON member: the decoded value as JSON text (keys sorted), its kind, and the raw
    text with a flag where decoding failed.  Other columns of a package do not come along."""
    rows = packages.select("id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("member"), J.decode(m).alias("d")) for m in J.SCHEMAS])).alias("m"))
    shape = F.expr("schema_of_variant(m.d.value)")
    kind = (F.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object")
            .when(shape == "VOID", "null").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
            .when(shape.isNotNull(), "number"))
    return rows.select("id", "m.member", kind.alias("kind"), F.to_json("m.d.value").alias("value"),
                       F.col("m.d.raw").alias("raw_text"), F.col("m.d.failed").alias("failed"))


def package_detail(packages: DataFrame) -> DataFrame:
    """Packages with every JSON member as the detail page gives it: decoded, or the raw text where that fails."""
    return packages.select(*[J.decode(c).alias(c) if c in J.SCHEMAS else F.col(c) for c in packages.columns])


def package_price_check(packages: DataFrame) -> DataFrame:
    """base = Σ hotel price x nights + transport + Σ charges; final = base − discount.

    Compares the recomputed base with the stored one per package.
    """
    p = parsed_packages(packages)
    hotel = J.money_total(F.col("hotels_v"), lambda h: h["price"] * h["nights"])
    charges = J.money_total(F.col("other_charges_v"), lambda c: c["amount"])
    transport = F.coalesce(F.col("transport_v.price"), F.lit(0)).cast("decimal(18,2)")
    out = p.select(
        "id", "base_price", "discount",
        hotel.alias("hotel_cost"), transport.alias("transport_cost"),
        charges.alias("other_cost"))
    computed = (F.col("hotel_cost") + F.col("transport_cost") + F.col("other_cost")).cast("decimal(18,2)")
    return out.select(
        "id", "hotel_cost", "transport_cost", "other_cost",
        computed.alias("computed_base"),
        F.col("base_price").cast("decimal(18,2)").alias("stored_base"),
        (computed == F.col("base_price")).alias("base_matches"),
        (F.col("base_price") - F.col("discount")).cast("decimal(18,2)").alias("final_price"))


def itinerary_days(packages: DataFrame) -> DataFrame:
    """One row per itinerary day (empty or bad itineraries give none)."""
    p = packages.select("id", F.explode(J.parse("itinerary")).alias("d"))
    return p.select(F.col("id").alias("package_id"), F.col("d.day").alias("day"),
                    F.col("d.description").alias("description"))


def package_json_encode(packages: DataFrame) -> DataFrame:
    """Re-encode the parsed members with ``to_json`` (canonical text)."""
    p = parsed_packages(packages)
    return p.select(
        "id",
        F.to_json("itinerary_v").alias("itinerary"),
        F.to_json("hotels_v").alias("hotels"),
        F.to_json("transport_v").alias("transport"),
        F.to_json("other_charges_v").alias("other_charges"))


def tag_counts(subcategories: DataFrame) -> DataFrame:
    """Comma-separated tags split, trimmed, counted (empty tags dropped)."""
    tags = subcategories.select(F.explode(F.split(F.col("tags"), r",\s*")).alias("tag"))
    return (tags.select(F.trim("tag").alias("tag")).where(F.col("tag") != "")
            .groupBy("tag").agg(F.count(F.lit(1)).alias("subcategories")))
