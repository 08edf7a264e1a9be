"""CRM entity tables derived from the driver's Parquet tables.

The test data is a TPC-H-like star schema; the CRM tables (users, leads,
bookings, ...) are projections of it.  Each mapping below is plain SQL that
both Spark SQL and DuckDB accept, so the same text builds the Spark view and
the oracle's CTE.  Base tables are written as ``{name}`` placeholders: Spark
binds them to DataFrames through ``spark.sql(text, name=df)``; the oracle
formats them to the pre-registered view names.  Literal braces are doubled.

These mappings only shape rows into the CRM schema; none of the CRM logic
lives here.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Row counts used by the mapping's modulus.  The oracle computes them with a
# scalar sub-query; Spark binds the same numbers once per data folder.
_N_USERS = "{n_supplier}"
_N_ORDERS = "{n_orders}"
_N_CUSTOMERS = "{n_customer}"   # smaller than the orders: several events per lead
COUNT_MARKERS = {"n_supplier": "supplier", "n_orders": "orders", "n_customer": "customer"}

# The driver tables' column types (TESTDATA), declared so a
# scan needs no footer-based schema inference.
BASE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def _code(prefix: str) -> str:
    return (f"concat('{prefix}-', CAST(year(o_orderdate) AS STRING), '-', "
            "lpad(CAST(o_orderkey AS STRING), "
            "CAST(greatest(5, length(CAST(o_orderkey AS STRING))) AS INT), '0'))")


# name -> (FROM clause, [(column, expression)], WHERE clause or None)
VIEWS: dict[str, tuple[str, list[tuple[str, str]], str | None]] = {
    "crm_users": ("{supplier}", [
        ("id", "s_suppkey"),
        ("username", "lower(s_name)"),
        ("full_name", "s_name"),
        ("role", "CASE WHEN s_suppkey % 10 = 0 THEN 'admin' "
                 "WHEN s_suppkey % 10 = 1 THEN 'manager' ELSE 'staff' END"),
        ("is_active", "CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END"),
    ], None),
    "crm_leads": ("{orders} JOIN {customer} ON o_custkey = c_custkey "
                  "JOIN {nation} ON c_nationkey = n_nationkey", [
        ("id", "o_orderkey"),
        ("lead_id", _code("LEAD")),
        ("customer_name", "c_name"),
        ("mobile", "concat('9', lpad(CAST(c_custkey AS STRING), 9, '0'))"),
        ("alt_mobile", "CASE WHEN c_custkey % 3 <> 0 THEN "
                       "concat('8', lpad(CAST(c_custkey AS STRING), 9, '0')) END"),
        ("city", "n_name"),
        ("tour_name", "concat('Tour ', n_name)"),
        ("travel_date", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT)"),
        ("adults", "CAST(1 + o_orderkey % 4 AS INT)"),
        ("children", "CAST(o_orderkey % 3 AS INT)"),
        ("hotel_category", "CASE o_orderstatus WHEN 'F' THEN 'Budget' "
                           "WHEN 'O' THEN 'Deluxe' ELSE 'Premium' END"),
        ("lead_source", "CASE c_mktsegment WHEN 'BUILDING' THEN 'Call' "
                        "WHEN 'FURNITURE' THEN 'Website' WHEN 'MACHINERY' THEN 'WhatsApp' "
                        "WHEN 'HOUSEHOLD' THEN 'Referral' ELSE 'Walk-in' END"),
        ("assigned_to", f"CASE WHEN o_orderkey % 101 = 0 THEN 999999 "
                        f"WHEN o_orderkey % 17 <> 0 THEN o_orderkey % {_N_USERS} END"),
        ("status", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Booked' "
                   "WHEN '2-HIGH' THEN 'Negotiation' WHEN '3-MEDIUM' THEN 'Follow-up' "
                   "WHEN '4-NOT SPECIFIED' THEN 'New Lead' ELSE 'Lost' END"),
        ("enquiry_date", "CAST(o_orderdate AS DATE)"),
        ("created_at", "o_orderdate"),
        ("is_deleted", "CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END"),
        ("deleted_at", "CASE WHEN o_orderkey % 23 = 0 THEN o_orderdate END"),
        ("deleted_by", "CASE WHEN o_orderkey % 23 = 0 THEN CAST(0 AS BIGINT) END"),
        ("tour_category_id", "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(n_regionkey AS BIGINT) END"),
        ("tour_subcategory_id", "CAST(n_nationkey AS BIGINT)"),
    ], None),
    "crm_bookings": ("{orders}", [
        ("id", "o_orderkey"),
        ("booking_id", _code("BOOKING")),
        ("lead_id", "o_orderkey"),
        ("user_id", f"o_orderkey % {_N_USERS}"),
        ("total_amount", "CAST(o_totalprice AS DECIMAL(10,2))"),
        ("discount", "CAST(100 * (o_orderkey % 5) AS DECIMAL(10,2))"),
        ("final_amount", "CAST(CAST(o_totalprice AS DECIMAL(10,2)) - "
                         "CAST(100 * (o_orderkey % 5) AS DECIMAL(10,2)) AS DECIMAL(10,2))"),
        ("payment_method", "CASE o_orderkey % 6 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Bank Transfer' "
                           "WHEN 2 THEN 'UPI' WHEN 3 THEN 'Cheque' WHEN 4 THEN 'Card' ELSE 'Other' END"),
        ("created_at", "o_orderdate"),
    ], "o_orderpriority = '1-URGENT' OR o_orderkey % 50 = 0"),
    # Bookings with the amounts that clients sent along; some disagree with the payments or with each other.
    "crm_stored_bookings": ("{orders} LEFT JOIN (SELECT l_orderkey AS paid_order, "
                            "CAST(SUM(CAST(l_extendedprice AS DECIMAL(10,2))) AS DECIMAL(18,2)) AS paid "
                            "FROM {lineitem} GROUP BY l_orderkey) p ON paid_order = o_orderkey", [
        ("id", "o_orderkey"),
        ("booking_id", _code("BOOKING")),
        ("lead_id", "o_orderkey"),
        ("user_id", f"o_orderkey % {_N_USERS}"),
        ("total_amount", "CAST(o_totalprice AS DECIMAL(10,2))"),
        ("discount", "CAST(100 * (o_orderkey % 5) AS DECIMAL(10,2))"),
        ("final_amount", "CAST(CAST(o_totalprice AS DECIMAL(10,2)) - 100 * (o_orderkey % 5) "
                         "+ CASE WHEN o_orderkey % 19 = 0 THEN 5 ELSE 0 END AS DECIMAL(10,2))"),
        ("advance_paid", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(COALESCE(paid, 0) "
                         "+ CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) END"),
        ("balance", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2)) "
                    "- 100 * (o_orderkey % 5) - COALESCE(paid, 0) "
                    "+ CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) END"),
        ("payment_method", "CASE o_orderkey % 3 WHEN 0 THEN 'Cash' WHEN 1 THEN 'UPI' ELSE 'Card' END"),
        ("payment_date", "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END"),
        ("created_at", "o_orderdate"),
    ], "(o_orderpriority = '1-URGENT' OR o_orderkey % 50 = 0) AND o_orderkey % 97 <> 0"),
    "crm_payments": ("{lineitem} JOIN {orders} ON l_orderkey = o_orderkey", [
        ("booking_id", "l_orderkey"),
        ("amount", "CAST(l_extendedprice AS DECIMAL(10,2))"),
        ("payment_method", "CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Cash' "
                           "WHEN 'AO' THEN 'Bank Transfer' WHEN 'NF' THEN 'UPI' "
                           "WHEN 'NO' THEN 'Cheque' WHEN 'RF' THEN 'Card' ELSE 'Other' END"),
        ("payment_date", "CAST(l_shipdate AS DATE)"),
    ], "o_orderpriority = '1-URGENT' OR o_orderkey % 50 = 0"),
    "crm_conversations": ("{events}", [
        ("id", "event_id"),
        ("lead_id", f"event_id % {_N_CUSTOMERS}"),
        ("user_id", f"user_id % {_N_USERS}"),
        ("call_result", "CASE event_id % 9 WHEN 0 THEN 'Not Connected' "
                        "WHEN 1 THEN 'Call Not Picked' WHEN 2 THEN 'Customer Busy' "
                        "WHEN 3 THEN 'Interested' WHEN 4 THEN 'Call Later' "
                        "WHEN 5 THEN 'Not Interested' WHEN 6 THEN 'Booking Confirmed' "
                        "WHEN 7 THEN 'Package Sent' ELSE 'Other' END"),
        ("call_type", "CASE WHEN event_type = 'click' THEN 'Incoming' ELSE 'Outgoing' END"),
        ("next_followup_date", "CASE WHEN event_type = 'view' THEN "
                               "CAST(ts AS DATE) + CAST(event_id % 7 AS INT) END"),
        ("call_duration", "CAST(floor(value) AS INT)"),
        ("created_at", "ts"),
    ], "event_type IN ('view', 'click', 'purchase')"),
    "crm_followups": ("{events}", [
        ("id", "event_id"),
        ("lead_id", f"event_id % {_N_CUSTOMERS}"),
        ("user_id", f"user_id % {_N_USERS}"),
        ("followup_date", "CAST(ts AS DATE) + CAST(event_id % 7 AS INT)"),
        ("status", "CASE event_id % 4 WHEN 0 THEN 'Completed' "
                   "WHEN 1 THEN 'Cancelled' ELSE 'Pending' END"),
        ("created_at", "ts"),
    ], "event_type = 'view'"),
    "crm_activity_logs": ("{events}", [
        ("id", "event_id"),
        ("user_id", f"CASE WHEN event_type <> 'error' THEN user_id % {_N_USERS} END"),
        ("action", "CASE event_type WHEN 'signup' THEN 'CREATE_LEAD' WHEN 'view' THEN 'LOGIN' "
                   "WHEN 'click' THEN 'ADD_CONVERSATION' WHEN 'purchase' THEN 'CREATE_BOOKING' "
                   "ELSE 'UPDATE_LEAD' END"),
        ("entity_type", "CASE event_type WHEN 'purchase' THEN 'booking' "
                        "WHEN 'view' THEN NULL ELSE 'lead' END"),
        ("entity_id", f"CASE WHEN event_type <> 'view' THEN event_id % {_N_ORDERS} END"),
        ("details", "concat('event ', CAST(event_id AS STRING))"),
        ("created_at", "ts"),
    ], None),
    "crm_packages": ("{part}", [
        ("id", "p_partkey"),
        ("lead_id", f"p_partkey % {_N_ORDERS}"),
        ("user_id", f"p_partkey % {_N_USERS}"),
        ("tour_name", "p_name"),
        ("itinerary", "CASE WHEN p_partkey % 13 = 0 THEN '[]' ELSE "
                      "concat('[{{\"day\": 1, \"description\": \"', p_type, "
                      "'\"}}, {{\"day\": 2, \"description\": \"', p_brand, '\"}}]') END"),
        ("hotels", "CASE WHEN p_partkey % 101 = 0 THEN 'oops' WHEN p_partkey % 19 = 0 THEN NULL "
                   "ELSE concat('[{{\"city\": \"X\", \"name\": \"H\", \"price\": ', "
                   "CAST(p_size * 100 AS STRING), ', \"nights\": ', "
                   "CAST(1 + p_partkey % 3 AS STRING), '}}]') END"),
        ("transport", "concat('{{\"type\": \"SUV\", \"price\": ', CAST(p_size * 10 AS STRING), '}}')"),
        ("other_charges", "CASE WHEN p_partkey % 2 = 0 THEN '[]' "
                          "ELSE '[{{\"name\": \"Welcome\", \"amount\": 1000}}]' END"),
        ("base_price", "CAST(p_retailprice AS DECIMAL(10,2))"),
        ("discount", "CAST(p_partkey % 50 AS DECIMAL(10,2))"),
    ], None),
    # Packages whose JSON texts are cut short, empty, absent or of another shape.
    "crm_package_drafts": ("{part}", [
        ("id", "p_partkey"),
        ("itinerary", "CASE WHEN p_partkey % 29 = 0 THEN '[{{\"day\": 1, \"descr' WHEN p_partkey % 31 = 0 THEN '' "
                      "ELSE concat('[{{\"day\": 1, \"description\": \"', p_type, '\"}}]') END"),
        ("hotels", "CASE WHEN p_partkey % 101 = 0 THEN 'oops' WHEN p_partkey % 19 = 0 THEN NULL "
                   "WHEN p_partkey % 11 = 0 THEN '[]' "
                   "ELSE concat('[{{\"price\": ', CAST(p_size * 100 AS STRING), ', \"city\": \"X\"}}, "
                   "{{\"city\": \"Y\", \"price\": 7}}]') END"),
        ("transport", "CASE WHEN p_partkey % 23 = 0 THEN '{{\"type\": \"SUV\", ' WHEN p_partkey % 37 = 0 THEN '\"van\"' "
                      "WHEN p_partkey % 41 = 0 THEN 'null' ELSE "
                      "concat('{{\"type\": \"SUV\", \"price\": ', CAST(p_size * 10 AS STRING), '}}') END"),
        ("other_charges", "CASE WHEN p_partkey % 43 = 0 THEN '5' WHEN p_partkey % 2 = 0 THEN '[]' "
                          "ELSE '[{{\"name\": \"Welcome\", \"amount\": 1000}}]' END"),
    ], None),
    "crm_tour_categories": ("{region}", [
        ("id", "r_regionkey"),
        ("name", "r_name"),
        ("sort_order", "r_regionkey % 2"),
        ("is_active", "1"),
    ], None),
    "crm_tour_subcategories": ("{nation}", [
        ("id", "n_nationkey"),
        ("category_id", "n_regionkey"),
        ("name", "n_name"),
        ("duration_days", "1 + n_nationkey % 8"),
        ("duration_nights", "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 8 END"),
        ("starting_price", "CAST(800 + n_nationkey * 500 AS DECIMAL(10,2))"),
        ("tags", "CASE n_nationkey % 4 WHEN 0 THEN 'Beach, Family' "
                 "WHEN 1 THEN 'Hills,Adventure, Family' WHEN 2 THEN '' ELSE 'Heritage' END"),
        ("sort_order", "n_nationkey % 3"),
        ("is_active", "CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 1 END"),
    ], None),
    "crm_whatsapp_logs": ("{conversations}", [
        ("id", "conv_id * 1000 + turn"),
        ("lead_id", "conv_id"),
        ("user_id", f"conv_id % {_N_USERS}"),
        ("message", "text"),
        ("turn", "turn"),
    ], "role = 'user'"),
    "crm_lead_notes": ("{conversations}", [
        ("id", "conv_id * 1000 + turn"),
        ("lead_id", "conv_id"),
        ("user_id", f"conv_id % {_N_USERS}"),
        ("note", "text"),
        ("color", "CASE WHEN turn % 2 = 0 THEN 'green' ELSE 'yellow' END"),
    ], "role = 'assistant'"),
    "crm_lead_assignments": ("{events}", [
        ("id", "event_id"),
        ("lead_id", f"event_id % {_N_CUSTOMERS}"),
        ("assigned_from", f"CASE WHEN event_id % 3 <> 0 THEN user_id % {_N_USERS} END"),
        ("assigned_to", f"(user_id + 1) % {_N_USERS}"),
        ("assigned_by", f"(user_id + 2) % {_N_USERS}"),
        ("created_at", "ts"),
    ], "event_type = 'signup'"),
    "crm_lead_requests": ("{orders} JOIN {customer} ON o_custkey = c_custkey", [
        ("request_id", "o_orderkey"),
        ("actor_id", f"o_orderkey % {_N_USERS}"),
        ("customer_name", "CASE WHEN o_orderkey % 31 <> 0 THEN c_name END"),
        ("mobile", "CASE WHEN o_orderkey % 37 = 0 THEN '' "
                   "ELSE concat('9', lpad(CAST(c_custkey AS STRING), 9, '0')) END"),
        ("travel_date", "CASE WHEN o_orderkey % 41 = 0 THEN '2001-13-45' "
                        "WHEN o_orderkey % 3 = 0 THEN NULL "
                        "ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"),
        ("pickup_location", "CASE WHEN o_orderkey % 3 = 1 THEN concat('Gate ', CAST(o_orderkey % 7 AS STRING)) END"),
        ("drop_location", "CASE WHEN o_orderkey % 4 = 1 THEN concat('Hotel ', CAST(o_orderkey % 5 AS STRING)) END"),
        ("hotel_category", "CASE o_orderkey % 5 WHEN 0 THEN 'Luxury' WHEN 1 THEN 'Budget' "
                           "WHEN 2 THEN 'Deluxe' WHEN 3 THEN 'Premium' END"),
        ("status", "CASE o_orderkey % 4 WHEN 0 THEN 'Booked' WHEN 1 THEN 'New Lead' "
                   "WHEN 2 THEN 'booked?' END"),
        ("assigned_to", "CASE WHEN o_orderkey % 43 = 0 THEN 999999 "
                        "WHEN o_orderkey % 11 = 0 THEN NULL "
                        f"ELSE o_orderkey % {_N_USERS} END"),
        ("created_at", "o_orderdate"),
    ], None),
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def view_sql(name: str) -> str:
    """Template text of one view (base tables still as ``{name}``)."""
    src, cols, where = VIEWS[name]
    select = ",\n       ".join(f"{expr} AS {col}" for col, expr in cols)
    text = f"SELECT {select}\nFROM {src}"
    if where:
        text += f"\nWHERE {where}"
    return text


def base_tables_of(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(view_sql(name))) - set(COUNT_MARKERS))


def counts_of(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(view_sql(name))) & set(COUNT_MARKERS))


def oracle_view_sql(name: str) -> str:
    """The view text with base tables bound to DuckDB's registered names."""
    binds = {t: t for t in BASE_TABLES}
    binds.update({m: f"(SELECT count(*) FROM {t})" for m, t in COUNT_MARKERS.items()})
    return view_sql(name).format(**binds)


def oracle_with(body: str) -> str:
    """Prefix ``body`` with CTEs for every ``crm_*`` view it mentions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    ctes = ",\n".join(f"{v} AS (\n{oracle_view_sql(v)}\n)" for v in used)
    stripped = body.lstrip()
    if re.match(r"(?i)with\s", stripped):
        return f"WITH {ctes},\n{stripped[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazily loaded base tables and CRM views of one data folder.

    ``tables.leads`` is the ``crm_leads`` view, ``tables.base('orders')`` the
    raw Parquet table.  Views are lazy DataFrames (no data is cached), so each
    query's plan reaches down to the Parquet scans and Catalyst can push
    filters and prune columns through the mapping.  ``Tables.of`` shares one
    instance per (session, folder), like a catalog: file listings and the
    analysed view plans are built once.
    """

    _shared: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}
        self._counts: dict[str, int] = {}

    @classmethod
    def of(cls, spark: SparkSession, data_dir: str) -> "Tables":
        key = (spark.sparkContext.applicationId, data_dir.rstrip("/"))
        t = cls._shared.get(key)
        if t is None or t.spark is not spark:
            t = cls._shared[key] = cls(spark, data_dir)
        return t

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            reader = self.spark.read
            if name in BASE_SCHEMAS:
                reader = reader.schema(BASE_SCHEMAS[name])
            self._base[name] = reader.parquet(f"{self.data_dir}/{name}.parquet")
        return self._base[name]

    def row_count(self, name: str) -> int:
        """Row count of a base table (Parquet answers it from footers)."""
        if name not in self._counts:
            self._counts[name] = self.base(name).count()
        return self._counts[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            binds: dict = {t: self.base(t) for t in base_tables_of(name)}
            binds.update({m: str(self.row_count(COUNT_MARKERS[m])) for m in counts_of(name)})
            self._views[name] = self.spark.sql(view_sql(name), **binds)
        return self._views[name]

    def __getattr__(self, item: str) -> DataFrame:
        key = f"crm_{item}"
        if key in VIEWS:
            return self.view(key)
        raise AttributeError(item)

    @cached_property
    def names(self) -> list[str]:
        return list(VIEWS)

    def materialize(self, out_dir: str, names: list[str] | None = None) -> "Tables":
        """Write the CRM views once as Parquet tables under ``out_dir`` and
        return ``Tables`` that read them instead of re-deriving them.

        ``out_dir`` must be shared storage (e.g. a folder under the session's
        checkpoint folder).  Every query on a derived view repeats the view's
        joins of the driver tables; on the written tables each query scans
        one table.  Tables with an ``id`` are range-partitioned and sorted by
        it (one shuffle, once), so every file holds its own id range and the
        Parquet min/max statistics let id filters skip whole files and row
        groups.  AQE sizes the number of files from the data.
        """
        out = out_dir.rstrip("/")
        for name in names or self.names:
            df = self.view(name)
            if "id" in df.columns:
                df = df.repartitionByRange("id").sortWithinPartitions("id")
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        return StoredTables(self.spark, self.data_dir, out, names or self.names)


class StoredTables(Tables):
    """``Tables`` whose CRM views are Parquet tables written by ``materialize``.

    Base tables (e.g. the event stream) still come from ``data_dir``.
    """

    def __init__(self, spark: SparkSession, data_dir: str, stored_dir: str, names: list[str]):
        super().__init__(spark, data_dir)
        self.stored_dir = stored_dir
        self.stored = set(names)

    def view(self, name: str) -> DataFrame:
        if name not in self.stored:
            return super().view(name)
        if name not in self._views:
            self._views[name] = self.spark.read.parquet(f"{self.stored_dir}/{name}")
        return self._views[name]
