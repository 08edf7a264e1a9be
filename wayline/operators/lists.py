"""Role-scoped lists, searches, pages and lookups.

Dimension lookups (user names) are left equi-joins on the user id; Spark
broadcasts the user side only while its estimated size is under the
configured threshold and otherwise shuffles both sides.  Pages and top-k
reports use ``orderBy(...).limit`` with an ``id`` tiebreak so results are
deterministic; Spark plans them as TakeOrderedAndProject (per-partition
top-k, then a merge of k rows per partition) rather than a full sort.
A page is cut *before* its lookups: the page's keys (at most a page size
of them) are broadcast into a semi-join that filters the looked-up table
map-side, so a page of 20 never shuffles the users or leads tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.dates import bucket_predicate, same_day
from wayline.functions.predicates import all_of, contains_any, like_any, py_strip, same_member, scope
from wayline.operators.quality import ENUMS
from wayline.operators.sequence import ordered_position, row_hash
from wayline.session import checkpoint_dir

SEARCH_COLUMNS = ["customer_name", "mobile", "alt_mobile", "tour_name", "lead_id"]


def user_names(users: DataFrame, id_alias: str, name_alias: str) -> DataFrame:
    """A two-column user lookup under role-specific names."""
    return users.select(F.col("id").alias(id_alias), F.col("full_name").alias(name_alias))


def for_page(table: DataFrame, table_key: str, page_rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose ``table_key`` occurs in ``page_rows[key]``.

    ``page_rows`` is one page (bounded by its page size), so its keys are
    broadcast under that bound and ``table`` is filtered map-side.
    """
    keys = page_rows.select(F.col(key).alias("__page_key")).where(F.col("__page_key").isNotNull())
    return table.join(F.broadcast(keys), table[table_key] == F.col("__page_key"), "left_semi")


def with_user_name(df: DataFrame, users: DataFrame, key: str, name_alias: str,
                   page: bool = False) -> DataFrame:
    """Left-join one user name onto ``df`` by ``df[key] = users.id``.

    ``page=True`` marks ``df`` as one page: only its users are looked up.
    """
    tmp = f"__{name_alias}_uid"
    lookup = user_names(for_page(users, "id", df, key) if page else users, tmp, name_alias)
    return df.join(lookup, df[key] == lookup[tmp], "left").drop(tmp)


def newest_first(*extra: Column) -> list[Column]:
    return [F.desc_nulls_last("created_at"), F.desc("id"), *extra]


def in_order(df: DataFrame, order: list[Column], page_no: int | None) -> DataFrame:
    """Restore a list's order after its lookups (a join keeps no order).

    A page holds at most a page size of rows and is sorted in one task; a
    full list gets a distributed sort.
    """
    if page_no is None:
        return df.orderBy(*order)
    return df.coalesce(1).sortWithinPartitions(*order)


MAX_PER_PAGE = 10_000


def page(df: DataFrame, order: list[Column], page_no: int | None, per_page: int) -> DataFrame:
    """One page (``page_no`` from 1) in ``order``; ``None`` keeps every row
    (unsorted: callers sort the full list once, after its lookups, with
    ``in_order``).

    A page (at most ``per_page`` rows) is checkpointed to the shared
    checkpoint folder: the page and the key lists built from it for its
    lookups then read those few rows, so the source is scanned and cut to
    the page once, not once per use.  A page's keys are broadcast to its lookups,
    so a page of more than ``MAX_PER_PAGE`` rows is refused, not cut.
    """
    if page_no is None:
        return df
    if not 0 < per_page <= MAX_PER_PAGE:
        raise ValueError(f"per_page must be between 1 and {MAX_PER_PAGE}")
    ordered = df.orderBy(*order)
    offset = (max(page_no, 1) - 1) * per_page
    if offset:
        ordered = ordered.offset(offset)
    checkpoint_dir(df.sparkSession)
    return ordered.limit(per_page).checkpoint(eager=True)


# -- users -----------------------------------------------------------------

def user_directory(users: DataFrame) -> DataFrame:
    """users without secrets, sorted by name."""
    return users.select("id", "username", "full_name", "role", "is_active").orderBy(
        F.asc_nulls_first("full_name"), "id")


def active_staff(users: DataFrame) -> DataFrame:
    """assignable staff."""
    return (users.where((F.col("role") == "staff") & (F.col("is_active") == 1))
            .select("id", "full_name").orderBy("full_name", "id"))


# -- leads -----------------------------------------------------------------

def lead_predicates(role: str | None = None, user_id: int | None = None,
                    status: str | None = None, assigned: int | None = None,
                    search: str | None = None, include_deleted: bool = False) -> Column:
    """The lead list's optional filters, AND-ed."""
    preds: list[Column] = []
    if not include_deleted:
        preds.append(F.col("is_deleted") == 0)
    preds += scope(role, user_id, "assigned_to", assigned)
    if status:
        # The text is resolved to members of the status list first (case and accents aside),
        # so that a plain IN reaches the scan.
        preds.append(F.col("status").isin(same_member(ENUMS["status"][0], status)))
    if search:
        preds.append(like_any(SEARCH_COLUMNS, search))
    return all_of(preds)


def lead_list(leads: DataFrame, users: DataFrame, *, page_no: int | None = 1,
              per_page: int = 20, **filters) -> DataFrame:
    """F2/L1: ``l.*`` plus the assignee's name, newest first, one page."""
    rows = page(leads.where(lead_predicates(**filters)), newest_first(), page_no, per_page)
    named = with_user_name(rows, users, "assigned_to", "assigned_name", page=page_no is not None)
    return in_order(named, newest_first(), page_no)


def lead_page_total(leads: DataFrame, per_page: int = 20, **filters) -> DataFrame:
    """Matching rows and page count for the same filters."""
    return (leads.where(lead_predicates(**filters))
            .agg(F.count(F.lit(1)).alias("total"))
            .select("total", F.ceil(F.col("total") / F.lit(per_page)).cast("bigint").alias("pages")))


def lead_search(leads: DataFrame, text: str, role: str | None = None,
                user_id: int | None = None, limit: int = 20) -> DataFrame:
    """Global search; LIKE wildcards in ``text`` stay live; deleted included; blank text finds nothing."""
    text = text.strip()
    if not text:
        leads = leads.limit(0)
    preds = [like_any(SEARCH_COLUMNS, text)] + scope(role, user_id, "assigned_to")
    return (leads.where(all_of(preds))
            .select("id", "lead_id", "customer_name", "mobile", "tour_name", "status",
                    "created_at")
            .orderBy(*newest_first()).limit(limit))


def recent_leads(leads: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
    """L2: newest leads (deleted included) with assignee name."""
    top = page(leads, newest_first(), 1, limit)
    named = in_order(with_user_name(top, users, "assigned_to", "assigned_name", page=True),
                     newest_first(), 1)
    return named.select("lead_id", "id", "customer_name", "mobile", "tour_name", "status",
                        "created_at", "assigned_name")


def lead_with_assignee(leads: DataFrame, users: DataFrame) -> DataFrame:
    """Every lead with its assignee's name (NULL when unassigned/unknown)."""
    named = with_user_name(leads.select("id", "lead_id", "assigned_to"), users,
                           "assigned_to", "assigned_name")
    return named


def new_leads_on_day(leads: DataFrame, day: str) -> DataFrame:
    """leads created on one calendar day."""
    return leads.where(same_day(F.col("created_at"), day)).select("id", "lead_id", "created_at")


def category_leads(leads: DataFrame, category_id: int, limit: int = 100) -> DataFrame:
    """newest leads of one tour category."""
    return (leads.where(F.col("tour_category_id") == category_id)
            .select("id", "lead_id", "customer_name", "mobile", "tour_name", "status",
                    "created_at")
            .orderBy(*newest_first()).limit(limit))


def trash_list(leads: DataFrame, users: DataFrame) -> DataFrame:
    """Soft-deleted leads with assignee and deleter names."""
    rows = leads.where(F.col("is_deleted") == 1)
    named = with_user_name(rows, users, "assigned_to", "assigned_name")
    named = with_user_name(named, users, "deleted_by", "deleted_by_name")
    return named.orderBy(F.desc_nulls_last("deleted_at"), F.desc("id"))


def leads_orphan_assignee(leads: DataFrame, users: DataFrame) -> DataFrame:
    """Leads whose assignee id matches no user (anti-join)."""
    ids = users.select(F.col("id").alias("uid"))
    return (leads.where(F.col("assigned_to").isNotNull())
            .join(ids, F.col("assigned_to") == F.col("uid"), "left_anti")
            .select("id", "lead_id", "assigned_to"))


def bookable_leads(leads: DataFrame, bookings: DataFrame) -> DataFrame:
    """Live leads without a booking yet."""
    booked = bookings.select(F.col("lead_id").alias("bk_lead"))
    return (leads.where(F.col("is_deleted") == 0)
            .join(booked, F.col("id") == F.col("bk_lead"), "left_anti")
            .select("id", "lead_id", "status"))


def duplicate_mobiles(leads: DataFrame) -> DataFrame:
    """Mobile numbers shared by more than one lead, with the lead count."""
    return (leads.groupBy("mobile").agg(F.count(F.lit(1)).alias("leads"),
                                         F.max("created_at").alias("latest_at"))
            .where(F.col("leads") > 1))


def _grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text (none for shorter texts)."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        starts, lambda i: F.substring(text, i, F.lit(size)))))


def duplicate_candidates(leads: DataFrame, typed: DataFrame, min_length: int = 10, limit: int = 20) -> DataFrame:
    """For each text typed into the lead form, the newest leads that the search finds for it.

    ``typed``: typed_id, text and, if present, role and user_id (staff see their own
    leads).  A text of at least ``min_length`` characters (stripped) is looked for
    inside each search column, case aside (``%`` and ``_`` are plain characters of a
    number); shorter and NULL texts find nothing.
    ``limit`` leads a text come back, newest first (deleted ones included), with their rank.

    No text meets every lead, and no lead travels once per run of its texts:

    * every text to look for holds a run of ``min_length`` characters, so the different
      texts and the different column values are cut into such runs; each text keeps the
      one that the fewest values hold and is tested in those values only;
    * the texts found come back to the leads by value, as row hash and text, and each
      lead row is read once per text;
    * the newest leads are chosen per text and scope (all leads, or those of one member
      of staff) before they meet the requests, so equal requests share one short list.
    """
    size = max(1, min_length)
    scoped = {"role", "user_id"} <= set(typed.columns)
    t = typed.select("typed_id", *[F.col(c).alias(f"_{c}") for c in ("role", "user_id") if scoped],
                     F.lower(py_strip(F.col("text"))).alias("_text"))
    t = t.where(F.length("_text") >= min_length)
    staff = (F.coalesce(F.col("_role"), F.lit("")) == "staff") if scoped else F.lit(False)
    t = t.withColumn("_own", staff)
    texts = t.groupBy("_text").agg(F.sort_array(F.collect_set("_own")).alias("_scopes"))
    wanted = texts.select("_text", "_scopes", F.explode(_grams(F.col("_text"), size)).alias("_gram"))

    shown = ["id", "lead_id", "customer_name", "mobile", "tour_name", "status", "created_at"]
    low = F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in SEARCH_COLUMNS])
    rows = leads.select(*dict.fromkeys(shown + ["assigned_to"] + SEARCH_COLUMNS))
    rows = rows.withColumn("_row", row_hash(rows))
    long_enough = F.filter(F.array_distinct(low), lambda c: F.length(c) >= size)
    held = rows.select("_row", F.explode(long_enough).alias("_value"))
    runs = held.select("_value").distinct().select("_value", F.explode(_grams(F.col("_value"), size)).alias("_held"))
    counts = runs.groupBy("_held").agg(F.count(F.lit(1)).alias("_n"))
    # A run that no value holds leaves its text without a count there: the text finds nothing.
    rated = wanted.join(counts, F.col("_gram") == F.col("_held"), "left")
    rarest = (rated.groupBy("_text", "_scopes").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_m"))
              .where("_m.n > 0").select("_text", "_scopes", F.col("_m._gram").alias("_gram")))
    found = (runs.join(rarest, F.col("_held") == F.col("_gram")).where(F.contains("_value", F.col("_text")))
             .select("_value", "_text", "_scopes"))
    # Rows of equal hash share their texts, so the text is looked for again in the row itself.
    texts_of = (held.join(found, "_value").select(F.col("_row").alias("_at"), "_text", "_scopes").distinct())
    hits = (rows.join(texts_of, F.col("_row") == F.col("_at"))
            .where(F.exists(low, lambda c: F.contains(c, F.col("_text")))))
    scopes = hits.select("_text", F.explode("_scopes").alias("_own"), *dict.fromkeys(shown + ["assigned_to"]))
    scopes = scopes.where(~F.col("_own") | F.col("assigned_to").isNotNull())
    who = lambda user: F.when(F.col("_own"), F.col(user))
    scopes = scopes.select("_text", "_own", who("assigned_to").alias("_who"), *shown)
    newest = [F.desc_nulls_last("created_at"), F.desc("id")]
    place = F.row_number().over(Window.partitionBy("_text", "_own", "_who").orderBy(*newest))
    short = scopes.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    asked = t.select("typed_id", F.col("_text").alias("_asked"), F.col("_own").alias("_mine"),
                     (who("_user_id") if scoped else F.lit(None)).alias("_user"))
    asked = asked.where(~F.col("_mine") | F.col("_user").isNotNull())
    got = asked.join(short, (F.col("_text") == F.col("_asked")) & (F.col("_own") == F.col("_mine"))
                     & F.col("_who").eqNullSafe(F.col("_user")))
    order = Window.partitionBy("typed_id").orderBy(*newest)
    return (got.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)
            .select("typed_id", "rank", *shown))


# -- follow-ups -------------------------------------------------------------

def followup_list(followups: DataFrame, leads: DataFrame, users: DataFrame, today: str,
                  bucket: str | None = None, role: str | None = None,
                  user_id: int | None = None) -> DataFrame:
    """Pending follow-ups of one tab with lead and staff.

    The lead code and the lead's numeric id come out as ``lead_code`` and
    ``lead_pk`` (the follow-up keeps its own ``lead_id``).
    """
    preds = [F.col("status") == "Pending", bucket_predicate(F.col("followup_date"), today, bucket)]
    preds += scope(role, user_id, "user_id")
    f = followups.where(all_of(preds))
    lk = leads.select(F.col("id").alias("lead_pk"), "customer_name", "mobile", "tour_name",
                      F.col("lead_id").alias("lead_code"))
    joined = f.join(lk, f["lead_id"] == lk["lead_pk"], "left")
    named = with_user_name(joined, users, "user_id", "staff_name")
    return named.orderBy(F.asc_nulls_first("followup_date"), "id")


# -- bookings ----------------------------------------------------------------

def _booking_details(b: DataFrame, leads: DataFrame, users: DataFrame, page: bool) -> DataFrame:
    """Attach the lead's customer fields and the staff name to bookings ``b``."""
    lead_src = for_page(leads, "id", b, "lead_id") if page else leads
    user_src = for_page(users, "id", b, "user_id") if page else users
    lk = lead_src.select(F.col("id").alias("l_pk"), "customer_name", "mobile", "tour_name", "travel_date")
    joined = b.join(lk, b["lead_id"] == lk["l_pk"], "left").drop("l_pk")
    return with_user_name(joined, user_src, "user_id", "staff_name")


def booking_rows(bookings: DataFrame, leads: DataFrame, users: DataFrame,
                 role: str | None = None, user_id: int | None = None) -> DataFrame:
    """Bookings with the lead's customer fields and the staff name."""
    b = bookings.where(all_of(scope(role, user_id, "user_id")))
    return _booking_details(b, leads, users, page=False)


def booking_list(bookings: DataFrame, leads: DataFrame, users: DataFrame, page_no: int | None = 1,
                 per_page: int = 20, role: str | None = None,
                 user_id: int | None = None) -> DataFrame:
    """One page of the booking list, newest first.

    The page is cut from the bookings alone (scope and order need no lead
    column); only its leads and staff are looked up.
    """
    b = page(bookings.where(all_of(scope(role, user_id, "user_id"))), newest_first(), page_no, per_page)
    return in_order(_booking_details(b, leads, users, page=page_no is not None), newest_first(), page_no)


def booking_search(rows: DataFrame, text: str) -> DataFrame:
    """literal case-insensitive filter on code, customer, mobile, tour."""
    return rows.where(contains_any(["booking_id", "customer_name", "mobile", "tour_name"], text))


def booking_page_totals(bookings: DataFrame, payments: DataFrame, page_rows: DataFrame,
                        per_page: int) -> DataFrame:
    """Money totals of one page, beside the global booking count.

    The page holds at most ``per_page`` ids, so it (and the payments summed
    for it) is broadcast under that proven bound.  One aggregate over all
    bookings then yields both the global count and the page sums.
    """
    money = "decimal(18,2)"
    page_ids = page_rows.select(F.col("id").alias("pid")).limit(per_page)
    paid = (payments.join(F.broadcast(page_ids), F.col("booking_id") == F.col("pid"), "left_semi")
            .groupBy(F.col("booking_id").alias("bid")).agg(F.sum("amount").alias("paid")))
    marked = (bookings.select("id", "final_amount")
              .join(F.broadcast(page_ids), F.col("id") == F.col("pid"), "left")
              .join(F.broadcast(paid), F.col("id") == F.col("bid"), "left"))
    in_page = F.col("pid").isNotNull()
    paid_c = F.coalesce(F.col("paid"), F.lit(0))
    return marked.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        F.count_if(in_page).alias("page_rows"),
        F.coalesce(F.sum(F.when(in_page, F.col("final_amount"))), F.lit(0)).cast(money).alias("page_final"),
        F.coalesce(F.sum(F.when(in_page, paid_c)), F.lit(0)).cast(money).alias("page_advance"),
        F.coalesce(F.sum(F.when(in_page, F.col("final_amount") - paid_c)), F.lit(0))
         .cast(money).alias("page_balance"))


# -- audit log -----------------------------------------------------------------

def activity_rows(activity: DataFrame, users: DataFrame) -> DataFrame:
    return with_user_name(activity, users, "user_id", "full_name")


def activity_feed(activity: DataFrame, users: DataFrame, limit: int = 100) -> DataFrame:
    """L4: newest audit rows with the actor's name."""
    top = page(activity, newest_first(), 1, limit)
    return in_order(with_user_name(top, users, "user_id", "full_name", page=True), newest_first(), 1)


def activity_search(activity: DataFrame, users: DataFrame, text: str) -> DataFrame:
    """F16: literal case-insensitive filter on action, actor name, details."""
    return activity_rows(activity, users).where(
        contains_any(["action", "full_name", "details"], text))


def assignment_history(assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Reassignment rows with from / to / by names (users joined 3x)."""
    out = with_user_name(assignments, users, "assigned_from", "from_name")
    out = with_user_name(out, users, "assigned_to", "to_name")
    out = with_user_name(out, users, "assigned_by", "by_name")
    return out.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


# -- packages ------------------------------------------------------------------

def package_by_id(packages: DataFrame, package_id: int) -> DataFrame:
    """primary-key lookup, pushed to the scan as a filter."""
    return packages.where(F.col("id") == package_id)


# -- sorted results with their positions ------------------------------------------

def with_rank(df: DataFrame, descending: str | None, ascending: list[str]) -> DataFrame:
    """A sorted list's order as a column ``rank`` (from 1): by ``descending`` (largest first, NULL last),
    then ``ascending`` (NULL first).  The list is sorted over all tasks; no single task numbers it."""
    key = "_falling"
    ranked = df if descending is None else df.withColumn(key, F.struct(
        F.col(descending).isNull().alias("n"), (-F.col(descending)).alias("v")))
    keys = ([] if descending is None else [key]) + ascending
    return ordered_position(ranked, [], keys, out_col="rank").drop(key)
