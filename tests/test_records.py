"""Stored records and awkward batches: decoded members, reconciliation, duplicate check, appends, fates of requests."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.fixtures import BOOKINGS_DDL, LEADS_DDL, df, lead, money, ts
from wayline.operators import changes as M
from wayline.operators import lists as L
from wayline.operators import packages as PK
from wayline.operators import quality as Q
from wayline.operators.sequence import position_within
from wayline.sources import io

AS_OF = "2026-04-01 00:00:00"


# -- X24 -------------------------------------------------------------------------------

@pytest.mark.parametrize("text,kind,value,raw,failed", [
    ("[]", "array", "[]", None, False), ('{"b": 1, "a": "x"}', "object", '{"a":"x","b":1}', None, False),
    ("5", "number", "5", None, False), ('"van"', "string", '"van"', None, False), ("null", "null", "null", None, False),
    ("true", "boolean", "true", None, False), ("oops", None, None, "oops", True), ('{"a": ', None, None, '{"a": ', True),
    (" ", None, None, " ", True), ("", None, None, "", False), (None, None, None, None, False)])
def test_member_is_decoded_or_kept_as_text(spark, text, kind, value, raw, failed):
    p = spark.createDataFrame([(1, text, "[]", None, "[")], "id INT, itinerary STRING, hotels STRING, transport STRING, other_charges STRING")
    rows = {r.member: r for r in PK.package_members(p).collect()}
    r = rows["itinerary"]
    assert (r.kind, r.value, r.raw_text, r.failed) == (kind, value, raw, failed)
    assert rows["other_charges"].failed and not rows["transport"].failed
    d = PK.package_detail(p).select("id", F.to_json("itinerary.value").alias("v"), "itinerary.raw", "itinerary.failed").first()
    assert (d.id, d.v, d.raw, d.failed) == (1, value, raw, failed)


# -- V4 ----------------------------------------------------------------------------------

def test_reconciliation_names_each_kind(spark):
    ddl = ("id BIGINT, total_amount DECIMAL(10,2), discount DECIMAL(10,2), final_amount DECIMAL(10,2), "
           "advance_paid DECIMAL(18,2), balance DECIMAL(18,2)")
    m = Decimal
    b = spark.createDataFrame([(1, m(100), m(10), m(90), m(40), m(50)), (2, m(100), m(10), m(95), m(0), m(95)),
                               (3, m(100), m(0), m(100), m(30), m(70)), (4, m(100), m(0), m(100), None, m(60)),
                               (5, m(100), m(0), m(100), m(150), None), (6, m(100), m(0), m(100), m(0), m(99))], ddl)
    p = spark.createDataFrame([(1, m(15)), (1, m(25)), (3, m(40)), (4, m(40)), (5, m(150)), (9, m(1)), (9, None)],
                              "booking_id BIGINT, amount DECIMAL(10,2)")
    got = {r.booking_pk: r.issues for r in Q.reconcile_bookings(b, p).collect()}
    assert got == {2: "final_mismatch", 3: "advance_not_payments,balance_not_payments", 4: "advance_missing",
                   5: "balance_missing,overpaid", 6: "balance_not_advance,balance_not_payments", 9: "payments_without_booking"}
    assert Q.reconcile_bookings(b.limit(0), p.limit(0)).count() == 0


# -- J14 -----------------------------------------------------------------------------------

def _candidate_leads(spark):
    rows = [(i, f"LEAD-2026-{i:05d}", f"Kunde Straße {i}", f"9{i:09d}", f"8{i:09d}" if i % 2 else None, "Goa Beach Tour",
             "New Lead", i % 3, ts(1 + i % 20)) for i in range(1, 60)]
    return spark.createDataFrame(rows, "id BIGINT, lead_id STRING, customer_name STRING, mobile STRING, alt_mobile STRING, "
                                       "tour_name STRING, status STRING, assigned_to INT, created_at TIMESTAMP_NTZ")


def test_duplicate_candidates_by_brute_force(spark):
    leads = _candidate_leads(spark)
    texts = ["9000000007", " 9000000007\t", "900000000", "00000000 7", "8000000007", "8000000008", "goa beach ", "GOA BEACH T", None, "",
             "LEAD-2026-0000", "kunde straße 1", "9%00000007", "Straße 12 and more", "aaaaaaaaaaaa"]
    typed = [(i, t, ["staff", "admin", None][i % 3], i % 4) for i, t in enumerate(texts)] + [(99, "9000000007", "staff", 1)]
    t = spark.createDataFrame(typed, "typed_id INT, text STRING, role STRING, user_id INT")
    want = []
    for k, text, role, user in typed:
        q = (text or "").strip().lower()
        found = [r for r in leads.collect() if len(q) >= 10 and any(
            q in (r[c] or "").lower() for c in L.SEARCH_COLUMNS) and (role != "staff" or r.assigned_to == user)]
        found.sort(key=lambda r: (r.created_at, r.id), reverse=True)
        want += [(k, n, r.id) for n, r in enumerate(found[:20], 1)]
    out = L.duplicate_candidates(leads, t)
    assert sorted((r.typed_id, r["rank"], r.id) for r in out.collect()) == sorted(want) and len(want) > 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert L.duplicate_candidates(leads, t.limit(0)).count() == 0 and L.duplicate_candidates(leads.limit(0), t).count() == 0


def _rows_made(df):
    """The most rows that any operator of a DataFrame's last run put out (its plan ran with AQE)."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind in ("AdaptiveSparkPlanExec",):
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            made = node.metrics().get("numOutputRows")
            most = max(most, made.get().value() if made.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_duplicate_candidates_of_a_text_typed_often(spark):
    # 400 leads hold a text that 900 requests look for: not one row for each of the 360,000 pairs.
    leads = spark.range(400).select(
        "id", F.concat(F.lit("LEAD-2026-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("lead_id"), F.lit(None).cast("string").alias("customer_name"),
        F.concat(F.lit("7"), F.lpad((F.col("id") * 7919).cast("string"), 9, "0")).alias("mobile"), F.lit(None).cast("string").alias("alt_mobile"),
        F.lit("Tour Unity").alias("tour_name"), F.lit("New Lead").alias("status"), (F.col("id") % 3).alias("assigned_to"),
        F.lit(ts(3)).cast("timestamp_ntz").alias("created_at"))
    typed = spark.range(900).select(F.col("id").alias("typed_id"), F.lit("tour UNITY").alias("text"),
                                    F.when(F.col("id") % 2 == 0, "staff").alias("role"), (F.col("id") % 5).alias("user_id"))
    out = L.duplicate_candidates(leads, typed)
    got = {}
    for r in out.collect():
        got.setdefault(r.typed_id, {})[r["rank"]] = r.id
    newest = list(range(399, -1, -1))
    for k in range(900):
        mine = newest if k % 2 else [i for i in newest if i % 3 == k % 5]
        assert [got.get(k, {}).get(n) for n in range(1, 21)] == (mine[:20] or [None] * 20)
    assert 900 < _rows_made(out) <= 900 * 20


def test_duplicate_candidates_of_repeated_rows(spark):
    # A lead that is stored twice is found twice, and a request id's rows share one ranking.
    leads = _candidate_leads(spark).where("id < 13")
    typed = spark.createDataFrame([(1, "goa beach tour", "admin", 0), (1, "goa beach tour", "admin", 0), (1, "8000000005", "staff", 2),
                                   (None, "LEAD-2026-00007", None, None), (3, "goa beach tour", "staff", None)],
                                  "typed_id INT, text STRING, role STRING, user_id INT")
    out = L.duplicate_candidates(leads.union(leads), typed).collect()
    ones = sorted((r["rank"], r.id) for r in out if r.typed_id == 1)
    # every lead is there 4 times (2 rows, 2 requests), newest first; lead 5 is also found by its second mobile
    want = sorted(([i for i in range(1, 13) for _ in range(4)] + [5, 5]), key=lambda i: (1 + i % 20, i), reverse=True)[:20]
    assert [i for _, i in ones] == want and [n for n, _ in ones] == list(range(1, 21))
    assert sorted((r["rank"], r.id) for r in out if r.typed_id is None) == [(1, 7), (2, 7)]
    assert not [r for r in out if r.typed_id == 3]


# -- S6 ------------------------------------------------------------------------------------

def test_a_retried_append_writes_once(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    io.append_batch(rows.where("id < 40"), path, "a")
    io.append_batch(rows.where("id >= 40 and id < 60"), path, "b")       # an attempt that wrote half
    io.append_batch(rows.where("id >= 40"), path, "b")
    io.append_batch(rows.where("id >= 40"), path, "b")
    back = io.read_appended(spark, path, rows.schema)
    assert back.count() == 100 and back.select("id").distinct().count() == 100
    assert {r.batch: r["count"] for r in back.groupBy("batch").count().collect()} == {"a": 40, "b": 60}
    with pytest.raises(ValueError):
        io.append_batch(rows, path, "../b")


# -- positions ---------------------------------------------------------------------------------

def test_positions_with_null_and_tied_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([None, None, 1, 1, 2, rng.randint(-50, 50)]), i) for i in range(900)]
    rows += [("a", None, 5000)] * 40                                      # equal in every column
    t = spark.createDataFrame(rows, "g STRING, k BIGINT, v INT")
    got = position_within(t, "g", "k", "p", n_ranges=9).collect()
    assert Counter((r.g, r.k, r.v) for r in got) == Counter(rows)
    for g in ("a", None):
        mine = sorted((r.p, r.k) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        keys = [(k is not None, k or 0) for _, k in mine]
        assert keys == sorted(keys)
    assert position_within(t.limit(0), "g", "k").count() == 0


# -- every request is applied or rejected ---------------------------------------------------------

def _accounted(batch, key, res):
    asked = Counter((r[key], r.seq) for r in batch.collect())
    done = Counter((r.request_key, r.seq) for r in res["applied"].union(res["rejects"].select("request_key", "seq")).collect())
    assert asked == done


def _batch(spark, rng, n, extra, ddl):
    rows = []
    for _ in range(n):
        row = (rng.choice([None, 1, 2, 3, 4, 99]), rng.choice([None, 1, 1, 2]), 1, rng.choice([None, "admin", "manager", "staff"]))
        rows.append(row + extra(rng))
    rows += rows[:5]
    return spark.createDataFrame(rows, "lead_pk BIGINT, seq BIGINT, actor_id BIGINT, role STRING" + ddl)


@pytest.mark.parametrize("seed", [1, 2])
def test_requests_in_are_applied_or_rejected(spark, seed):
    rng = random.Random(seed)
    leads = df(spark, LEADS_DDL, [lead(1, "New Lead"), lead(2, "Lost"), lead(3, "Lost", deleted=1), lead(4, "Lost", deleted=1)])
    bookings = df(spark, BOOKINGS_DDL, [(1, "BOOKING-2026-00001", 2, 2, money(10), money(0), money(10), "Cash", ts(12))])
    pays = spark.createDataFrame([], "booking_id BIGINT, amount DECIMAL(10,2)")
    plain = _batch(spark, rng, 25, lambda r: (), "")
    _accounted(plain, "lead_pk", M.apply_soft_delete(leads, plain, AS_OF))
    _accounted(plain, "lead_pk", M.apply_restore(leads, plain, AS_OF))
    res = M.apply_hard_delete({"leads": leads, "bookings": bookings, "payments": pays}, plain, AS_OF)
    _accounted(plain, "lead_pk", res)
    assert res["applied"].count() == res["audit"].count() == 4 - res["leads"].count()
    moves = _batch(spark, rng, 25, lambda r: (r.choice([None, 0, 5, 6]), None), ", new_assignee BIGINT, notes STRING")
    res = M.apply_reassign(leads, moves, AS_OF)
    _accounted(moves, "lead_pk", res)
    # The history of a lead ends on its assignee, whatever ties.
    after = {r.id: r.assigned_to for r in res["leads"].collect()}
    hist = [(r.lead_id, r.assigned_from, r.assigned_to) for r in res["lead_assignments"].collect()]
    stored = {r.id: r.assigned_to for r in leads.collect()}
    for k in {h[0] for h in hist}:
        ends = Counter(h[2] for h in hist if h[0] == k)
        ends.subtract(Counter(h[1] for h in hist if h[0] == k))
        left = {x: n for x, n in ends.items() if n}
        assert left == {} if after[k] == stored[k] else left == {after[k]: 1, stored[k]: -1}
    wants = _batch(spark, rng, 25, lambda r: (money(5), money(0), money(5), money(1), money(4), None, None, None),
                   ", total_amount DECIMAL(10,2), discount DECIMAL(10,2), final_amount DECIMAL(10,2), "
                   "advance_paid DECIMAL(10,2), balance DECIMAL(10,2), payment_method STRING, payment_date STRING, notes STRING")
    res = M.apply_bookings({"leads": leads, "bookings": bookings}, wants, AS_OF)
    _accounted(wants, "lead_pk", res)
    assert res["bookings_new"].count() == 1                              # lead 1 is the only live one without a booking


def test_packages_are_stored_once_whatever_ties(spark):
    rng = random.Random(7)
    packages = spark.createDataFrame([(i, 1, 1, "old") for i in (1, 2, 3)], "id BIGINT, lead_id BIGINT, user_id BIGINT, tour_name STRING")
    rows = [(rng.choice(["create", "update", "update", None, "drop"]), rng.choice([None, 1, 2, 9]), rng.choice([None, 1, 1]), 1, 1,
             rng.choice(["x", "y"])) for _ in range(40)]
    batch = spark.createDataFrame(rows, "op STRING, package_id BIGINT, seq BIGINT, lead_pk BIGINT, actor_id BIGINT, tour_name STRING")
    res = M.apply_packages(packages, batch, AS_OF)
    ids = [r.id for r in res["packages"].collect()]
    creates = sum(r[0] == "create" for r in rows)
    assert sorted(ids) == list(range(1, 4 + creates))
    _accounted(batch, "package_id", res)


def test_null_roles_are_forbidden(spark):
    leads = df(spark, LEADS_DDL, [lead(1, "New Lead", deleted=1)])
    ask = spark.createDataFrame([(1, 1, 1, None, 5, None)],
                                "lead_pk BIGINT, seq BIGINT, actor_id BIGINT, role STRING, new_assignee BIGINT, notes STRING")
    empty = spark.createDataFrame([], "id BIGINT, lead_id BIGINT")
    pays = spark.createDataFrame([], "booking_id BIGINT")
    results = [M.apply_soft_delete(leads, ask, AS_OF), M.apply_restore(leads, ask, AS_OF), M.apply_reassign(leads, ask, AS_OF),
               M.apply_hard_delete({"leads": leads, "bookings": empty, "payments": pays}, ask, AS_OF)]
    for res in results:
        assert [r.reason.split()[0] for r in res["rejects"].collect()] == ["Forbidden"]
        assert res["applied"].isEmpty() and res["leads"].count() == 1
    notes = spark.createDataFrame([(1, 1, 2, "n", "green")], "id BIGINT, lead_id BIGINT, user_id BIGINT, note STRING, color STRING")
    adds = spark.createDataFrame([], "id BIGINT, lead_pk BIGINT, actor_id BIGINT, note STRING, color STRING")
    drop = spark.createDataFrame([(1, 1, None, 3), (1, 2, "", 3), (1, None, None, None)], "note_id BIGINT, seq BIGINT, role STRING, actor_id BIGINT")
    res = M.apply_notes(notes, adds, drop)
    assert res["lead_notes"].count() == 1 and {r.reason for r in res["rejects"].collect()} == {"Forbidden"}
    assert M.apply_notes(notes, adds, drop.withColumn("actor_id", F.lit(2)))["lead_notes"].count() == 0


# -- T2 without requests ------------------------------------------------------------------------------

def test_a_stream_without_requests_has_empty_outputs(spark, tmp_path):
    from tests.conftest import SF001
    from wayline.sources.views import BASE_SCHEMAS
    from wayline.streaming import change_stream as CS
    from wayline.streaming.files import stream_table

    events = spark.read.schema(BASE_SCHEMAS["events"]).parquet(f"{SF001}/events.parquet")
    leads = df(spark, LEADS_DDL, [lead(1, "New Lead")])
    for name, rows in (("none", events.limit(0)), ("few", events.limit(50))):
        folder, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        rows.write.parquet(folder)
        requests = CS.conversation_requests(stream_table(spark, folder, events.schema), 1, 5)
        CS.run_conversation_stream(spark, requests, leads, out, str(tmp_path / f"{name}-ckpt"), AS_OF)
        got = {o: CS.read_output(spark, out, o) for o in CS.OUTPUTS}
        assert all(d.columns for d in got.values())
        assert (sum(d.count() for d in got.values()) > 0) == (name == "few")
        assert CS.current_status(leads, got["lead_status_changes"]).count() == 1
