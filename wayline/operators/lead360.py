"""One-to-many nesting around a lead: history, child counts, documents.

The reference assembles a lead's detail page with one query per child
table.  Here every lead is handled in one pass, and the shapes are chosen
so no single key can overload a task:

* children are counted per lead with partial (map-side) aggregation;
* the same-mobile history keeps only the newest ``k + 1`` rows per mobile
  (Spark plans a WindowGroupLimit before the shuffle), so joining it back
  yields at most ``k + 1`` partners per lead -- never all pairs of a group;
* the nested document is emitted in parts of bounded size, cut by position: a
  lead with many children is split over several rows, in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.sequence import ordered_position, with_previous
from wayline.session import checkpoint_dir

# Fixed value: lists of up to so many items are grouped in one row and cut there, however small the parts.
WHOLE_LIST = 1000

HISTORY_COLUMNS = ["id", "lead_id", "customer_name", "tour_name", "status", "created_at"]


def newest_per_key(df: DataFrame, key: str, k: int, rank_col: str | None = None) -> DataFrame:
    """The ``k`` newest rows per ``key`` (ties broken by higher id).

    Spark plans a partial ``WindowGroupLimit`` before the shuffle, so a hot
    key sends at most ``k`` rows per map task.  ``rank_col`` keeps the rank.
    """
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    out = df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return out.withColumnRenamed("_rk", rank_col) if rank_col else out.drop("_rk")


def customer_history(leads: DataFrame, k: int = 5) -> DataFrame:
    """For every lead, the ``k`` newest other leads with its mobile.

    Soft-deleted leads are included on both sides, as on the detail page.
    The ``k + 1`` newest leads of each mobile become one sorted array (a
    bounded group); each lead joins its mobile's single array row, drops
    itself and keeps the first ``k`` -- exactly its ``k`` newest others.
    No lead meets more than ``k + 1`` candidates, and after the join only
    row-level work remains, so AQE may split a hot mobile's side freely.
    Output: ``lead_pk``, ``rnk`` (1 = newest) and the other lead's columns.
    """
    top = newest_per_key(leads.select("mobile", *HISTORY_COLUMNS), "mobile", k + 1, "_rk")
    lists = (top.groupBy(F.col("mobile").alias("_m"))
             .agg(F.sort_array(F.collect_list(F.struct("_rk", *HISTORY_COLUMNS))).alias("_top")))
    me = leads.select(F.col("id").alias("lead_pk"), "mobile")
    pairs = me.join(lists, me["mobile"] == lists["_m"], "inner")
    others = F.slice(F.filter("_top", lambda x: x["id"] != F.col("lead_pk")), 1, k)
    out = pairs.select("lead_pk", F.posexplode(others).alias("_p", "_h"))
    return out.select("lead_pk", (F.col("_p") + 1).cast("bigint").alias("rnk"),
                      *[F.col("_h")[c].alias(c) for c in HISTORY_COLUMNS])


def _tag(df: DataFrame, key: str, kind: str, n: F.Column | None = None) -> DataFrame:
    return df.select(F.col(key).alias("lead_pk"), F.lit(kind).alias("kind"),
                     (n if n is not None else F.lit(1).cast("bigint")).alias("n"))


CHILD_KINDS = ("conversations", "followups", "packages", "bookings", "payments",
               "whatsapp_logs", "pinned_notes", "assignments")


def child_counts(conversations: DataFrame, followups: DataFrame, packages: DataFrame,
                 bookings: DataFrame, payments: DataFrame, whatsapp: DataFrame,
                 notes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per lead id, the number of rows in each child table (sparse).

    Payments reach a lead through its booking: they are summed per booking
    first, then mapped to the booking's lead.
    """
    pay_per_booking = (payments.groupBy(F.col("booking_id").alias("bid"))
                       .agg(F.count(F.lit(1)).alias("n")))
    pay = (bookings.select(F.col("id").alias("bk"), "lead_id")
           .join(pay_per_booking, F.col("bk") == F.col("bid"), "inner"))
    tagged = reduce(DataFrame.unionByName, [
        _tag(conversations, "lead_id", "conversations"),
        _tag(followups, "lead_id", "followups"),
        _tag(packages, "lead_id", "packages"),
        _tag(bookings, "lead_id", "bookings"),
        _tag(pay, "lead_id", "payments", F.col("n")),
        _tag(whatsapp, "lead_id", "whatsapp_logs"),
        _tag(notes, "lead_id", "pinned_notes"),
        _tag(assignments, "lead_id", "assignments"),
    ])
    return tagged.groupBy("lead_pk").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("bigint").alias(f"n_{k}")
          for k in CHILD_KINDS])


def lead_360_counts(leads: DataFrame, counts: DataFrame, history_limit: int = 5) -> DataFrame:
    """J8 summary: for each live lead, its children per table and history size."""
    per_mobile = leads.groupBy(F.col("mobile").alias("hm")).agg(F.count(F.lit(1)).alias("same_mobile"))
    live = leads.where(F.col("is_deleted") == 0).select("id", "lead_id", "mobile")
    out = (live.join(counts, live["id"] == counts["lead_pk"], "left")
           .join(per_mobile, live["mobile"] == per_mobile["hm"], "left"))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "id", "lead_id",
        *[F.coalesce(F.col(f"n_{k}"), zero).alias(f"n_{k}") for k in CHILD_KINDS],
        F.least(F.col("same_mobile") - 1, F.lit(history_limit)).cast("bigint").alias("n_history"))


def with_staff_name(child: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """A child table plus ``staff_name``, the full name of the user that it names (NULL if unknown)."""
    names = users.select(F.col("id").alias("_su"), F.col("full_name").alias("staff_name"))
    return child.join(names, child[key] == names["_su"], "left").drop("_su")


def _sort_number(child: DataFrame, name: str, ascending: bool) -> F.Column:
    """A sort column as one number that rises in the wanted order (NULL first rising, last falling)."""
    kind = child.schema[name].dataType.typeName()
    c = F.col(name)
    if kind == "date":
        n = F.unix_date(c).cast("bigint")
    elif kind.startswith("timestamp"):
        n = F.unix_micros(c.cast("timestamp"))
    else:
        n = c.cast("bigint")
    least, most = F.lit(-2**63).cast("bigint"), F.lit(2**63 - 1).cast("bigint")
    return F.coalesce(n, least) if ascending else F.coalesce(-n, most)


def document_parts(leads: DataFrame, users: DataFrame, members: dict[str, tuple],
                   part_size: int = 1000, scope: F.Column | None = None, bounds: dict[str, int] | None = None) -> DataFrame:
    """J8/S5 nested lead document, emitted in parts of at most ``part_size`` items.

    ``members`` maps a member name to ``(child_df, lead_key, sort_columns,
    ascending)`` with one or two integer, date or timestamp sort columns.  Items
    are in the order of the sort columns (NULLs first rising, last falling; then
    the JSON text, rising), and part ``p`` holds positions ``p * part_size + 1``
    and on, so the parts of a member are its list cut in order, at every size.

    Every child row is serialised with ``to_json`` once.  Lists that fit one part, or
    have at most ``WHOLE_LIST`` items, are grouped straight away and cut in their row:
    the JSON text moves once.  Which lists are longer is
    counted before from the keys alone (per-task sums first), and only their rows are
    placed with ``ordered_position`` (range partitions: a lead with millions of
    children is spread over many tasks) and cut by position.  ``bounds`` gives the most
    items that a member can have for a lead (a history of five); such a list is not counted.  ``scope`` is a condition on
    leads, such as a staff member's own.  Output columns: ``lead_pk``,
    ``member``, ``part``, ``parts``, ``items`` (array of JSON objects).
    """
    live = leads.where(F.col("is_deleted") == 0)
    if scope is not None:
        live = live.where(scope)
    names = users.select(F.col("id").alias("_u"), F.col("full_name").alias("assigned_name"))
    head = live.join(names, live["assigned_to"] == names["_u"], "left").drop("_u")
    lead = head.select(
        F.col("id").alias("lead_pk"), F.lit("lead").alias("member"), F.lit(0).alias("part"),
        F.lit(1).alias("parts"), F.array(F.to_json(F.struct(*head.columns))).alias("items"))
    live_ids = live.select(F.col("id").alias("_lid"))
    bounds = bounds or {}
    whole_size = max(part_size, WHOLE_LIST)
    counted = [child.select(F.col(key).alias("_l"), F.lit(member).alias("_m"))
               for member, (child, key, _, _) in members.items() if bounds.get(member, whole_size + 1) > whole_size]
    some_long = bool(counted)
    if some_long:
        checkpoint_dir(leads.sparkSession)
        lists = reduce(DataFrame.unionByName, counted).groupBy("_l", "_m").agg(F.count(F.lit(1)).alias("_n"))
        long_lists = lists.where(F.col("_n") > whole_size).select(
            "_l", "_m", F.ceil(F.col("_n") / part_size).cast("int").alias("_parts")).checkpoint(eager=True)
        some_long = not long_lists.isEmpty()
    rows = []
    for member, (child, key, sort_cols, ascending) in members.items():
        numbers = [_sort_number(child, c, ascending) for c in sort_cols] + [F.lit(0).cast("bigint")] * (2 - len(sort_cols))
        rows.append(child.select(F.col(key).alias("lead_pk"), F.lit(member).alias("member"),
                                numbers[0].alias("k1"), numbers[1].alias("k2"),
                                F.to_json(F.struct(*child.columns)).alias("j")))
    # The rows meet their leads and then their lists by lead: the text moves once.
    stacked = reduce(DataFrame.unionByName, rows)
    stacked = stacked.join(live_ids, stacked["lead_pk"] == live_ids["_lid"], "left_semi")
    short = stacked
    if some_long:
        same = (stacked["lead_pk"] == long_lists["_l"]) & (stacked["member"] == long_lists["_m"])
        short = stacked.join(long_lists, same, "left_anti")
    whole = (short.groupBy("lead_pk", "member").agg(F.sort_array(F.collect_list(F.struct("k1", "k2", "j"))).alias("arr"))
             .select("lead_pk", "member", F.transform("arr", lambda x: x["j"]).alias("items")))
    if whole_size > part_size:
        parts = F.ceil(F.size("items") / part_size).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.slice("items", p * part_size + 1, part_size))
        whole = whole.select("lead_pk", "member", F.posexplode(pieces).alias("part", "items"), parts.alias("parts"))
    else:
        whole = whole.withColumns({"part": F.lit(0), "parts": F.lit(1)})
    whole = whole.select("lead_pk", "member", "part", "parts", "items")
    out = lead.unionByName(whole)
    if some_long:
        placed = ordered_position(stacked.join(long_lists.drop("_parts"), same, "left_semi"), ["lead_pk", "member"],
                                  ["k1", "k2", "j"], out_col="_pos")
        part = F.floor((F.col("_pos") - 1) / F.lit(part_size)).cast("int")
        cut = (placed.groupBy("lead_pk", "member", part.alias("part"))
               .agg(F.sort_array(F.collect_list(F.struct("_pos", "j"))).alias("arr")))
        cut = cut.join(long_lists, (cut["lead_pk"] == long_lists["_l"]) & (cut["member"] == long_lists["_m"])).select(
            "lead_pk", "member", "part", F.col("_parts").alias("parts"), F.transform("arr", lambda x: x["j"]).alias("items"))
        out = out.unionByName(cut)
    return out


def category_tree(categories: DataFrame, subcategories: DataFrame,
                  part_size: int = 1000) -> DataFrame:
    """Each category with its sub-categories (inactive ones included),
    sorted by (sort_order, name, id), NULLs first.

    The nested list is emitted in parts of at most ``part_size`` consecutive
    sub-categories: positions come from ``ordered_position`` (range blocks,
    so a category with millions of sub-categories is spread over many tasks)
    and part = (position - 1) div ``part_size``.  A category without
    sub-categories has one empty part.  Output: ``id``, ``name``,
    ``sort_order``, ``n_subcategories``, ``part``, ``parts``,
    ``subcategory_names`` ('|'-joined names of the part), ``subcategories``.
    """
    rest = [c for c in subcategories.columns if c not in ("sort_order", "name", "id", "category_id")]
    subs = subcategories.select(F.col("category_id").alias("cid"), "sort_order", "name", "id", *rest)
    pos = ordered_position(subs, ["cid"], ["sort_order", "name", "id"], out_col="_pos")
    sizes = subs.groupBy(F.col("cid").alias("_sc")).agg(F.count(F.lit(1)).alias("_n"))
    grouped = (pos.groupBy("cid", F.floor((F.col("_pos") - 1) / F.lit(part_size)).cast("int").alias("part"))
               .agg(F.sort_array(F.collect_list(F.struct(
                   "_pos", "sort_order", "name", "id", *rest))).alias("_arr")))
    grouped = grouped.select(
        "cid", "part",
        F.transform("_arr", lambda s: F.struct(*[s[c].alias(c) for c in ("sort_order", "name", "id", *rest)]))
        .alias("subcategories"))
    out = (categories.join(sizes, categories["id"] == sizes["_sc"], "left")
           .join(grouped, categories["id"] == grouped["cid"], "left"))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    arr = F.coalesce(F.col("subcategories"), F.array().cast(grouped.schema["subcategories"].dataType))
    return out.select(
        "id", "name", "sort_order", n.alias("n_subcategories"),
        F.coalesce(F.col("part"), F.lit(0)).alias("part"),
        F.greatest(F.ceil(n / F.lit(part_size)), F.lit(1)).cast("int").alias("parts"),
        F.array_join(F.transform(arr, lambda s: s["name"]), "|").alias("subcategory_names"),
        arr.alias("subcategories"))


def assignment_chain_breaks(assignments: DataFrame) -> DataFrame:
    """Reassignment rows whose ``assigned_from`` is not the previous ``assigned_to``.

    The previous row of a lead's history (ordered by time, then id) is
    attached with ``with_previous`` -- the same result as ``lag`` over
    ``partitionBy(lead_id)``, computed without sending a lead's whole history
    to one task.  The first row of a lead has no predecessor and is skipped.
    """
    prev = with_previous(assignments, ["lead_id"], ["created_at", "id"], ["assigned_to"])
    return (prev.where(F.col("has_prev") & ~F.col("assigned_from").eqNullSafe(F.col("prev_assigned_to")))
            .select("id", "lead_id", "created_at", "assigned_from", "prev_assigned_to"))
