"""Registered nesting, package-document and label queries (J8-J10, W1, W3, X)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators import labels as LB
from wayline.operators import lead360 as N
from wayline.functions import jsonpkg as J
from wayline.operators import packages as PK
from wayline.plans import params as P
from wayline.plans.registry import register


def _counts(t):
    return N.child_counts(t.conversations, t.followups, t.packages, t.bookings, t.payments,
                          t.whatsapp_logs, t.lead_notes, t.lead_assignments)


_HISTORY_SQL = f"""
SELECT lead_pk, rnk, id, lead_id, customer_name, tour_name, status, created_at FROM (
  SELECT a.id AS lead_pk, b.id, b.lead_id, b.customer_name, b.tour_name, b.status, b.created_at,
         row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC NULLS LAST, b.id DESC) AS rnk
  FROM crm_leads a JOIN crm_leads b ON a.mobile = b.mobile AND a.id <> b.id) x
WHERE rnk <= {P.HISTORY_LIMIT}"""


@register("customer_history_top5", family="nested", oracle=_HISTORY_SQL)
def customer_history_top5(t):
    return N.customer_history(t.leads, P.HISTORY_LIMIT)


@register("lead_360_counts", family="nested", oracle=f"""
SELECT l.id, l.lead_id,
  (SELECT COUNT(*) FROM crm_conversations c WHERE c.lead_id = l.id) AS n_conversations,
  (SELECT COUNT(*) FROM crm_followups f WHERE f.lead_id = l.id) AS n_followups,
  (SELECT COUNT(*) FROM crm_packages p WHERE p.lead_id = l.id) AS n_packages,
  (SELECT COUNT(*) FROM crm_bookings b WHERE b.lead_id = l.id) AS n_bookings,
  (SELECT COUNT(*) FROM crm_payments p JOIN crm_bookings b ON p.booking_id = b.id
    WHERE b.lead_id = l.id) AS n_payments,
  (SELECT COUNT(*) FROM crm_whatsapp_logs w WHERE w.lead_id = l.id) AS n_whatsapp_logs,
  (SELECT COUNT(*) FROM crm_lead_notes n WHERE n.lead_id = l.id) AS n_pinned_notes,
  (SELECT COUNT(*) FROM crm_lead_assignments a WHERE a.lead_id = l.id) AS n_assignments,
  least((SELECT COUNT(*) FROM crm_leads o WHERE o.mobile = l.mobile AND o.id <> l.id),
        {P.HISTORY_LIMIT}) AS n_history
FROM crm_leads l WHERE l.is_deleted = 0""")
def lead_360_counts(t):
    return N.lead_360_counts(t.leads, _counts(t), P.HISTORY_LIMIT)


# The columns of each lead document member, in the order
# Spark serialises them (the child views' columns), with their JSON kind:
# n = number, s = string, d = date, t = timestamp, j = JSON text as it is.
_DOC_COLUMNS = {
    "lead": "id:n lead_id:s customer_name:s mobile:s alt_mobile:s city:s tour_name:s travel_date:d "
            "adults:n children:n hotel_category:s lead_source:s assigned_to:n status:s enquiry_date:d "
            "created_at:t is_deleted:n deleted_at:t deleted_by:n tour_category_id:n "
            "tour_subcategory_id:n assigned_name:s",
    "conversations": "id:n lead_id:n user_id:n call_result:s call_type:s next_followup_date:d "
                     "call_duration:n created_at:t staff_name:s",
    "followups": "id:n lead_id:n user_id:n followup_date:d status:s created_at:t staff_name:s",
    "packages": "id:n lead_id:n user_id:n tour_name:s itinerary:j hotels:j transport:j "
                "other_charges:j base_price:n discount:n",
    "bookings": "id:n booking_id:s lead_id:n user_id:n total_amount:n discount:n final_amount:n "
                "payment_method:s created_at:t",
    "payments": "booking_id:n amount:n payment_method:s payment_date:d lead_id:n",
    "whatsapp_logs": "id:n lead_id:n user_id:n message:s turn:n staff_name:s",
    "pinned_notes": "id:n lead_id:n user_id:n note:s color:s",
    "history": "lead_pk:n rnk:n id:n lead_id:s customer_name:s tour_name:s status:s created_at:t",
}
_JSON_VALUE = {"j": "{}", "n": "CAST({} AS VARCHAR)", "s": "CAST(to_json({}) AS VARCHAR)",
               "d": "concat('\"', strftime({}, '%Y-%m-%d'), '\"')",
               "t": "concat('\"', strftime({}, '%Y-%m-%dT%H:%M:%S.%g'), '\"')"}


def _json_object_sql(member: str, alias: str) -> str:
    """DuckDB text equal to Spark's ``to_json(struct(...))`` of one child row
    (NULL fields left out, timestamps in milliseconds, decimals at scale)."""
    pairs = []
    for spec in _DOC_COLUMNS[member].split():
        col, kind = spec.split(":")
        v = f"{alias}.{col}"
        pairs.append(f"""CASE WHEN {v} IS NOT NULL THEN '"{col}":' || {_JSON_VALUE[kind].format(v)} END""")
    return "concat('{', concat_ws(',', " + ", ".join(pairs) + "), '}')"


# member -> (source rows, lead key, sort keys, ascending)
_DOC_MEMBERS = {
    "conversations": ("conv", "lead_id", ["created_at", "id"], False),
    "followups": ("fol", "lead_id", ["followup_date", "id"], True),
    "packages": ("pkg", "lead_id", ["id"], False),
    "bookings": ("crm_bookings", "lead_id", ["id"], True),
    "payments": ("pay", "lead_id", ["payment_date"], False),
    "whatsapp_logs": ("wa", "lead_id", ["id"], False),
    "pinned_notes": ("crm_lead_notes", "lead_id", ["id"], False),
    "history": ("hist", "lead_pk", ["rnk"], True),
}


def _lead_360_oracle(part_size: int) -> str:
    parts = []
    for member, (src, key, keys, asc) in _DOC_MEMBERS.items():
        d = "ASC NULLS FIRST" if asc else "DESC NULLS LAST"
        text = _json_object_sql(member, "x")
        order = ", ".join([f"x.{k} {d}" for k in keys] + [text])
        parts.append(f"""SELECT lead_pk, '{member}' AS member, CAST((rn - 1) // {part_size} AS INTEGER) AS part,
       CAST(ceil(MAX(n) / {part_size}) AS INTEGER) AS parts, string_agg(j, ',' ORDER BY rn) AS items
FROM (SELECT x.{key} AS lead_pk, {text} AS j, row_number() OVER (PARTITION BY x.{key} ORDER BY {order}) AS rn,
             COUNT(*) OVER (PARTITION BY x.{key}) AS n FROM {src} x) y GROUP BY 1, 3""")
    members = "\nUNION ALL\n".join(parts)
    parsed = ", ".join(f"{json_text_sql(m, a)} AS {m}" for m, a in
                       (("itinerary", "it"), ("hotels", "h"), ("transport", "tr"), ("other_charges", "oc")))
    return f"""
WITH hist AS ({_HISTORY_SQL}),
{_PARSED.strip()},
staff AS (SELECT id AS su, full_name AS staff_name FROM crm_users),
conv AS (SELECT c.*, staff_name FROM crm_conversations c LEFT JOIN staff ON su = c.user_id),
fol AS (SELECT c.*, staff_name FROM crm_followups c LEFT JOIN staff ON su = c.user_id),
wa AS (SELECT c.*, staff_name FROM crm_whatsapp_logs c LEFT JOIN staff ON su = c.user_id),
pkg AS (SELECT c.id, c.lead_id, c.user_id, c.tour_name, {parsed}, c.base_price, c.discount
        FROM crm_packages c JOIN p ON p.id = c.id),
pay AS (SELECT p.booking_id, p.amount, p.payment_method, p.payment_date, b.lead_id
        FROM crm_payments p JOIN crm_bookings b ON p.booking_id = b.id),
head AS (SELECT l.*, u.full_name AS assigned_name
         FROM crm_leads l LEFT JOIN crm_users u ON l.assigned_to = u.id WHERE l.is_deleted = 0),
docs AS (
SELECT x.id AS lead_pk, 'lead' AS member, 0 AS part, 1 AS parts, {_json_object_sql('lead', 'x')} AS items FROM head x
UNION ALL
{members})
SELECT lead_pk, member, part, parts, concat('[', items, ']') AS items
FROM docs WHERE lead_pk IN (SELECT id FROM crm_leads WHERE is_deleted = 0)"""


def lead_documents(t, part_size, scope=None):
    """Nested documents of every live lead, each part's items as one JSON array text."""
    pay = t.payments.join(t.bookings.select(F.col("id").alias("_b"), F.col("lead_id")),
                          F.col("booking_id") == F.col("_b"), "inner").drop("_b")
    history = N.customer_history(t.leads, P.HISTORY_LIMIT)
    packages = t.packages.select(*[J.parse(c).alias(c) if c in J.SCHEMAS else F.col(c) for c in t.packages.columns])
    members = {
        "conversations": (N.with_staff_name(t.conversations, t.users), "lead_id", ["created_at", "id"], False),
        "followups": (N.with_staff_name(t.followups, t.users), "lead_id", ["followup_date", "id"], True),
        "packages": (packages, "lead_id", ["id"], False),
        "bookings": (t.bookings, "lead_id", ["id"], True),
        "payments": (pay, "lead_id", ["payment_date"], False),
        "whatsapp_logs": (N.with_staff_name(t.whatsapp_logs, t.users), "lead_id", ["id"], False),
        "pinned_notes": (t.lead_notes, "lead_id", ["id"], False),
        "history": (history, "lead_pk", ["rnk"], True),
    }
    docs = N.document_parts(t.leads, t.users, members, part_size, scope, {"history": P.HISTORY_LIMIT})
    return docs.withColumn("items", F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))


@register("category_tree", family="nested", oracle=f"""
WITH s AS (
  SELECT category_id, name, COUNT(*) OVER (PARTITION BY category_id) AS n,
         row_number() OVER (PARTITION BY category_id
                            ORDER BY sort_order NULLS FIRST, name NULLS FIRST, id) AS rn
  FROM crm_tour_subcategories),
g AS (
  SELECT category_id, CAST((rn - 1) // {P.TREE_PART_SIZE} AS INTEGER) AS part, MAX(n) AS n,
         string_agg(name, '|' ORDER BY rn) AS names
  FROM s GROUP BY 1, 2)
SELECT c.id, c.name, c.sort_order, CAST(COALESCE(g.n, 0) AS BIGINT) AS n_subcategories,
       COALESCE(g.part, 0) AS part,
       CAST(greatest(ceil(COALESCE(g.n, 0) / {P.TREE_PART_SIZE}), 1) AS INTEGER) AS parts,
       COALESCE(g.names, '') AS subcategory_names
FROM crm_tour_categories c LEFT JOIN g ON g.category_id = c.id""")
def category_tree(t):
    return N.category_tree(t.tour_categories, t.tour_subcategories,
                           P.TREE_PART_SIZE).drop("subcategories")


@register("assignment_chain_breaks", family="nested", oracle="""
SELECT id, lead_id, created_at, assigned_from, prev_assigned_to FROM (
  SELECT *, lag(assigned_to) OVER w AS prev_assigned_to, lag(id) OVER w AS prev_id
  FROM crm_lead_assignments
  WINDOW w AS (PARTITION BY lead_id ORDER BY created_at NULLS FIRST, id)) x
WHERE prev_id IS NOT NULL AND assigned_from IS DISTINCT FROM prev_assigned_to""")
def assignment_chain_breaks(t):
    return N.assignment_chain_breaks(t.lead_assignments)


_PARSED = """
p AS (SELECT id, base_price, discount,
  CASE WHEN json_valid(itinerary) THEN from_json(itinerary,
       '[{"day":"INTEGER","description":"VARCHAR"}]') END AS it,
  CASE WHEN json_valid(hotels) THEN from_json(hotels,
       '[{"city":"VARCHAR","name":"VARCHAR","price":"DECIMAL(10,2)","nights":"INTEGER"}]') END AS h,
  CASE WHEN json_valid(transport) THEN from_json(transport,
       '{"type":"VARCHAR","price":"DECIMAL(10,2)"}') END AS tr,
  CASE WHEN json_valid(other_charges) THEN from_json(other_charges,
       '[{"name":"VARCHAR","amount":"DECIMAL(10,2)"}]') END AS oc
  FROM crm_packages)"""


@register("package_price_check", family="nested", oracle=f"""
WITH {_PARSED},
q AS (SELECT id, base_price, discount,
  CAST(COALESCE(list_sum(list_transform(h, lambda x: COALESCE(x.price * x.nights, 0))), 0)
       AS DECIMAL(18,2)) AS hotel_cost,
  CAST(COALESCE(tr.price, 0) AS DECIMAL(18,2)) AS transport_cost,
  CAST(COALESCE(list_sum(list_transform(oc, lambda x: COALESCE(x.amount, 0))), 0)
       AS DECIMAL(18,2)) AS other_cost
  FROM p)
SELECT id, hotel_cost, transport_cost, other_cost,
       CAST(hotel_cost + transport_cost + other_cost AS DECIMAL(18,2)) AS computed_base,
       CAST(base_price AS DECIMAL(18,2)) AS stored_base,
       (hotel_cost + transport_cost + other_cost) = base_price AS base_matches,
       CAST(base_price - discount AS DECIMAL(18,2)) AS final_price
FROM q""")
def package_price_check(t):
    return PK.package_price_check(t.packages)


@register("itinerary_days", family="nested", oracle="""
SELECT id AS package_id, d.day AS day, d.description AS description FROM (
  SELECT id, unnest(CASE WHEN json_valid(itinerary) THEN
         from_json(itinerary, '[{"day":"INTEGER","description":"VARCHAR"}]') END) AS d
  FROM crm_packages) x""")
def itinerary_days(t):
    return PK.itinerary_days(t.packages)


def _json_field_sql(x: str, field) -> str:
    """One ``"name":value`` pair as ``to_json`` writes it; NULL when the field is NULL."""
    v = f"{x}.{field.name}"
    text = (f"CAST(to_json({v}) AS VARCHAR)" if isinstance(field.dataType, T.StringType)
            else f"CAST({v} AS VARCHAR)")
    return f"""CASE WHEN {v} IS NOT NULL THEN '"{field.name}":' || {text} END"""


def json_text_sql(member: str, parsed: str) -> str:
    """DuckDB text equal to Spark's ``to_json`` of a parsed package member.

    ``to_json`` leaves out NULL fields and writes decimals at their scale;
    DuckDB's own encoder keeps NULLs, so the oracle writes the text itself.
    """
    schema = J.SCHEMAS[member]
    struct = schema.elementType if isinstance(schema, T.ArrayType) else schema

    def obj(x: str) -> str:
        pairs = ", ".join(_json_field_sql(x, f) for f in struct.fields)
        return f"('{{' || concat_ws(',', {pairs}) || '}}')"

    if not isinstance(schema, T.ArrayType):
        return obj(f"({parsed})")
    items = f"list_transform({parsed}, lambda x: CASE WHEN x IS NULL THEN 'null' ELSE {obj('x')} END)"
    return f"('[' || COALESCE(array_to_string({items}, ','), '') || ']')"


@register("lead_360", family="nested", oracle=_lead_360_oracle(P.DOC_PART_SIZE))
def lead_360(t):
    """Nested lead documents for every live lead, split into bounded parts by position."""
    return lead_documents(t, P.DOC_PART_SIZE)


@register("lead_360_small_parts", family="nested", oracle=_lead_360_oracle(2))
def lead_360_small_parts(t):
    """The same documents in parts of two items, so that lists really are cut."""
    return lead_documents(t, 2)


@register("package_json_encode", family="nested", oracle=f"""
WITH {_PARSED}
SELECT id, {json_text_sql("itinerary", "it")} AS itinerary,
       {json_text_sql("hotels", "h")} AS hotels,
       {json_text_sql("transport", "tr")} AS transport,
       {json_text_sql("other_charges", "oc")} AS other_charges
FROM p""")
def package_json_encode(t):
    return PK.package_json_encode(t.packages)


@register("tag_counts", family="nested", oracle=r"""
SELECT tag, COUNT(*) AS subcategories FROM (
  SELECT trim(unnest(regexp_split_to_array(tags, ',\s*'))) AS tag FROM crm_tour_subcategories) x
WHERE tag <> '' GROUP BY tag""")
def tag_counts(t):
    return PK.tag_counts(t.tour_subcategories)


@register("activity_labels", family="nested", oracle=f"""
SELECT id, action_label, initial, actor,
  CASE WHEN mins < 60 THEN concat(CAST(mins AS VARCHAR), 'm ago')
       WHEN floor(mins / 60) < 24 THEN concat(CAST(CAST(floor(mins / 60) AS BIGINT) AS VARCHAR), 'h ago')
       ELSE concat(CAST(CAST(floor(floor(mins / 60) / 24) AS BIGINT) AS VARCHAR), 'd ago') END AS age
FROM (
  SELECT a.id, replace(a.action, '_', ' ') AS action_label,
         substr(COALESCE(NULLIF(u.full_name, ''), '?'), 1, 1) AS initial,
         COALESCE(NULLIF(u.full_name, ''), 'System') AS actor,
         CAST(floor((epoch_ms(TIMESTAMP '{P.ACTIVITY_AS_OF}') - epoch_ms(a.created_at)) / 60000) AS BIGINT) AS mins
  FROM crm_activity_logs a LEFT JOIN crm_users u ON a.user_id = u.id) x""")
def activity_labels(t):
    return LB.activity_labels(t.activity_logs, t.users, P.ACTIVITY_AS_OF)


@register("subcategory_labels", family="nested", oracle="""
SELECT id, name,
  CASE WHEN COALESCE(duration_days, 0) <> 0 THEN
    concat(COALESCE(CAST(duration_nights AS VARCHAR), 'null'), 'N/', CAST(duration_days AS VARCHAR), 'D')
  END AS duration_label,
  CASE WHEN is_active = 1 THEN 'Active' ELSE 'Inactive' END AS state
FROM crm_tour_subcategories""")
def subcategory_labels(t):
    return LB.subcategory_labels(t.tour_subcategories)


@register("lead_display", family="nested", oracle=f"""
SELECT id,
  COALESCE(regexp_matches(mobile, '{LB.MOBILE_RE}'), false) AS mobile_ok,
  regexp_matches(alt_mobile, '{LB.MOBILE_RE}') AS alt_mobile_ok,
  travel_date < DATE '{P.AS_OF_DAY}' AS travel_passed,
  COALESCE(enquiry_date, CAST(created_at AS DATE)) AS shown_date
FROM crm_leads""")
def lead_display(t):
    return LB.lead_display(t.leads, P.AS_OF_DAY)
