"""Golden unit tests on invented rows shaped like the seed data (FIXTURES B)."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.fixtures import (ASSIGN_DDL, BOOKINGS_DDL, CATS_DDL, CONV_DDL, FOLLOWUPS_DDL,
                            LEADS_DDL, PACKAGES_DDL, PAYMENTS_DDL, SUBS_DDL, USERS_DDL, T0, df,
                            lead, money, ts)
from wayline.functions import numbers as N
from wayline.functions.predicates import contains_any, like_any
from wayline.operators import changes as M
from wayline.operators import codes as C
from wayline.operators import lead360 as L3
from wayline.operators import packages as PK
from wayline.operators import quality as Q
from wayline.operators import reports as R


def _seed(spark):
    users = df(spark, USERS_DDL, [(1, "adm", "Admin One", "admin", 1), (2, "sa", "Staff A", "staff", 1),
                                  (3, "sb", "Staff B", "staff", 1), (4, "sc", "Staff C", "staff", 1)])
    leads = df(spark, LEADS_DDL, [lead(1, "Follow-up"), lead(2, "New Lead")])
    conv = df(spark, CONV_DDL, [(i, 1, 2 if i > 1 else 1, "Interested", "Outgoing", None, 3, ts(10 + i))
                                for i in range(1, 8)])
    bookings = df(spark, BOOKINGS_DDL, [(1, "BOOKING-2026-00001", 1, 2, money(10000), money(2000),
                                         money(8000), "Cash", ts(12))])
    payments = df(spark, PAYMENTS_DDL, [(1, money(5000), "Cash", dt.date(2026, 3, 12))])
    return users, leads, conv, bookings, payments


def test_staff_scorecard_golden(spark):
    users, leads, conv, bookings, _ = _seed(spark)
    rows = {r["id"]: r for r in R.staff_performance(users, leads, conv, bookings).collect()}
    assert set(rows) == {2, 3, 4}                       # admin excluded, idle staff kept
    r2 = rows[2]
    assert (r2.total_leads, r2.new_leads, r2.converted, r2.lost, r2.total_calls, r2.bookings) == \
        (2, 1, 0, 0, 6, 1)
    assert r2.revenue == money(8000)
    assert all(rows[u].total_leads == 0 and rows[u].revenue == money(0) for u in (3, 4))
    rates = {r["id"]: r for r in R.staff_rates(R.staff_performance(users, leads, conv, bookings)).collect()}
    assert rates[2].conversion_pct == 0 and rates[2].avg_ticket == 8000 and rates[3].avg_ticket == 0


def test_booking_arithmetic_and_trend(spark):
    users, leads, _, bookings, payments = _seed(spark)
    b = R.booking_balances(bookings, payments).collect()[0]
    assert (b.final_amount, b.paid, b.balance) == (money(8000), money(5000), money(3000))
    m = R.monthly_bookings(bookings, "2026-04-01 00:00:00").collect()
    assert [(r.month, r.bookings, r.revenue) for r in m] == [("2026-03", 1, money(8000))]
    mism = Q.booked_status_mismatch(leads, bookings).collect()
    assert [(r.lead_pk, r.issue) for r in mism] == [(1, "booking_not_booked")]


def test_overpaid_booking_shows_paid(spark):
    _, _, _, bookings, _ = _seed(spark)
    pays = df(spark, PAYMENTS_DDL, [(1, money(9000), "UPI", dt.date(2026, 3, 13))])
    st = R.booking_payment_state(R.booking_balances(bookings, pays)).collect()[0]
    assert st.balance == money(-1000) and st.state == "Paid"


def test_package_pricing_identity(spark):
    rows = [
        (1, 1, 2, "A", "[]", json.dumps([{"city": "X", "name": "H1", "price": 3500, "nights": 2},
                                          {"city": "Y", "name": "H2", "price": 2000, "nights": 1}]),
         json.dumps({"type": "SUV", "price": 3000}), json.dumps([{"name": "Fee", "amount": 1000}]),
         money(13000), money(1000)),
        (2, 1, 2, "B", "[]", json.dumps([{"city": "X", "name": "H", "price": 1500, "nights": 2}]),
         json.dumps({"type": "Sedan", "price": 2000}), "[]", money(5000), money(500)),
        (3, 2, 2, "C", "[]", "[]", "{}", json.dumps([{"name": "Visa", "amount": 545}]), money(545), money(0)),
        (4, 2, 2, "D", None, None, "not json", "oops", money(0), money(0)),
    ]
    p = df(spark, PACKAGES_DDL, rows)
    got = {r.id: r for r in PK.package_price_check(p).collect()}
    assert [got[i].computed_base for i in (1, 2, 3)] == [money(13000), money(5000), money(545)]
    assert [got[i].final_price for i in (1, 2, 3)] == [money(12000), money(4500), money(545)]
    assert all(got[i].base_matches for i in (1, 2, 3, 4))
    assert got[4].hotel_cost == money(0) and got[4].transport_cost == money(0)
    assert PK.itinerary_days(p).count() == 0


def test_followup_buckets(spark):
    today = dt.date(2026, 5, 10)
    rows = []
    for i, delta in enumerate((0, 1, 2, -1)):
        rows.append((i, 1, 2, today + dt.timedelta(days=delta), "Pending", T0))
        rows.append((10 + i, 1, 2, today + dt.timedelta(days=delta), "Completed", T0))
    f = df(spark, FOLLOWUPS_DDL, rows)
    got = {r.bucket: r.cnt for r in R.followup_bucket_counts(f, "2026-05-10").collect()}
    assert got == {"today": 1, "tomorrow": 1, "upcoming": 1, "overdue": 1}


def test_category_edges(spark):
    cats = df(spark, CATS_DDL, [(1, "Empty", 0, 1), (2, "OnlyInactive", 1, 1), (3, "Full", 1, 0)])
    subs = df(spark, SUBS_DDL, [(10, 2, "Off", 3, None, money(900), "", 0, 0),
                                (11, 3, "B", 4, 3, money(900), "Beach, Family", 1, 1),
                                (12, 3, "A", 2, 1, money(900), "Family", 1, 1)])
    leads = df(spark, LEADS_DDL, [lead(1, cat=3), lead(2, cat=3), lead(3, cat=99)])
    st = {r.id: r for r in R.category_stats(cats, subs, leads).collect()}
    assert (st[1].subcat_count, st[2].subcat_count, st[3].subcat_count) == (0, 0, 2)
    assert st[3].lead_count == 2 and st[1].lead_count == 0
    tree = {r.id: r for r in L3.category_tree(cats, subs).collect()}
    assert tree[2].n_subcategories == 1 and tree[1].n_subcategories == 0
    assert tree[3].subcategory_names == "A|B"
    split = {(r.id, r.part): r for r in L3.category_tree(cats, subs, part_size=1).collect()}
    assert sorted(split) == [(1, 0), (2, 0), (3, 0), (3, 1)]
    assert (split[(3, 0)].subcategory_names, split[(3, 1)].subcategory_names) == ("A", "B")
    assert split[(3, 1)].parts == 2 and split[(1, 0)].parts == 1
    assert split[(1, 0)].subcategory_names == "" and split[(3, 1)].n_subcategories == 2
    tot = R.category_totals(R.category_stats(cats, subs, leads), subs).collect()[0]
    assert (tot.categories, tot.active_categories, tot.subcategories, tot.leads) == (3, 2, 3, 2)
    tags = {r.tag: r.subcategories for r in PK.tag_counts(subs).collect()}
    assert tags == {"Beach": 1, "Family": 2}


def test_search_wildcards_live_vs_literal(spark):
    leads = df(spark, LEADS_DDL, [lead(1, name="A_B"), lead(2, name="AxB"), lead(3, name="50%off")])
    live = {r.id for r in leads.where(like_any(["customer_name"], "A_B")).collect()}
    literal = {r.id for r in leads.where(contains_any(["customer_name"], "a_b")).collect()}
    pct = {r.id for r in leads.where(like_any(["customer_name"], "50%")).collect()}
    assert live == {1, 2} and literal == {1} and pct == {3}


def test_literal_search_ignores_case_and_accents(spark):
    leads = df(spark, LEADS_DDL, [lead(1, name="José Müller"), lead(2, name="JOSE"),
                                  lead(3, name="Straße"), lead(4, name="Josh")])
    hit = lambda q: {r.id for r in leads.where(contains_any(["customer_name"], q)).collect()}
    assert hit("josé") == {1, 2} and hit("MULLER") == {1} and hit("strasse") == {3}
    like = lambda q: {r.id for r in leads.where(like_any(["customer_name"], q)).collect()}
    assert like("jos_ m%ller") == {1} and like("JOSÉ") == {1, 2} and like("stra") == {3}
    assert like("strasse") == {3} and like("STRAẞE".replace("ẞ", "ß")) == {3}
    caesar = df(spark, LEADS_DDL, [lead(5, name="Cæsar"), lead(6, name="Caesar"), lead(7, name="Casar")])
    assert {r.id for r in caesar.where(like_any(["customer_name"], "caesar")).collect()} == {5, 6}
    assert {r.id for r in caesar.where(like_any(["customer_name"], "CÆSAR")).collect()} == {5, 6}


def test_status_filter_ignores_case(spark):
    from wayline.operators.lists import lead_predicates

    leads = df(spark, LEADS_DDL, [lead(1, "Follow-up"), lead(2, "Follow-up"), lead(3, "New Lead")])
    assert {r.id for r in leads.where(lead_predicates(status="FOLLOW-UP")).collect()} == {1, 2}


def test_booking_code_max_ignores_malformed(spark):
    rows = [(1, "BOOKING-2026-00012", 1, 2, money(1), money(0), money(1), "Cash", T0),
            (2, "BOOKING-2026-0001x", 2, 2, money(1), money(0), money(1), "Cash", T0),
            (3, "BOOKING-2026-123456", 3, 2, money(1), money(0), money(1), "Cash", T0),
            (4, "BOOKING-2025-00099", 4, 2, money(1), money(0), money(1), "Cash", T0)]
    b = df(spark, BOOKINGS_DDL, rows)
    got = {r.year: r.max_seq for r in C.booking_code_max(b).collect()}
    assert got == {2026: 12, 2025: 99}


def test_history_top5_matches_brute_force(spark):
    # six leads share one mobile, two of them with the same created_at
    rows = [lead(i, mobile="9111111111", created=ts(1 + (i if i != 6 else 5))) for i in range(1, 7)]
    rows += [lead(7, mobile="9222222222"), lead(8, mobile="9222222222", created=ts(20))]
    leads = df(spark, LEADS_DDL, rows)
    got = sorted((r.lead_pk, r.rnk, r.id) for r in L3.customer_history(leads, 5).collect())
    a, b = leads.alias("a"), leads.alias("b")
    pairs = a.join(b, (F.col("a.mobile") == F.col("b.mobile")) & (F.col("a.id") != F.col("b.id")))
    w = Window.partitionBy("a.id").orderBy(F.desc("b.created_at"), F.desc("b.id"))
    brute = (pairs.select(F.col("a.id").alias("p"), F.col("b.id").alias("o"),
                          F.row_number().over(w).alias("r")).where("r <= 5"))
    want = sorted((r.p, r.r, r.o) for r in brute.collect())
    assert got == want and len([g for g in got if g[0] == 1]) == 5


def test_history_on_hot_mobile_matches_brute_force(spark):
    # one mobile holds a third of 900 leads; timestamps repeat, NULL mobiles never match
    rows = [lead(i, mobile="9000000000" if i % 3 == 0 else (None if i % 50 == 1 else f"9{i % 40:09d}"),
                 created=ts(1 + (i * 7) % 13)) for i in range(1, 901)]
    leads = df(spark, LEADS_DDL, rows).repartition(6)
    got = L3.customer_history(leads, 5).select("lead_pk", "rnk", "id")
    a, b = leads.alias("a"), leads.alias("b")
    pairs = a.join(b, (F.col("a.mobile") == F.col("b.mobile")) & (F.col("a.id") != F.col("b.id")))
    w = Window.partitionBy("a.id").orderBy(F.desc_nulls_last("b.created_at"), F.desc("b.id"))
    want = (pairs.select(F.col("a.id").alias("lead_pk"), F.row_number().over(w).cast("bigint").alias("rnk"),
                         F.col("b.id").alias("id")).where("rnk <= 5"))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_assignment_chain_breaks(spark):
    rows = [(1, 1, None, 2, 9, ts(1)), (2, 1, 2, 3, 9, ts(2)), (3, 1, 5, 6, 9, ts(3)),
            (4, 2, None, 4, 9, ts(1))]
    a = df(spark, ASSIGN_DDL, rows)
    got = [(r.id, r.prev_assigned_to) for r in L3.assignment_chain_breaks(a).collect()]
    assert got == [(3, 3)]


def test_position_within_matches_row_number(spark):
    data = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"),
                                       (F.col("id") % 3).alias("part"))
    got = C.position_within(data, "part", "k", n_ranges=16)
    w = Window.partitionBy("part").orderBy("k")
    want = data.withColumn("pos", F.row_number().over(w))
    assert got.select("part", "k", "pos").exceptAll(want.select("part", "k", "pos")).count() == 0
    assert got.count() == 5000


def test_reassign_chain_in_one_batch(spark):
    leads = df(spark, LEADS_DDL, [lead(1, assigned=1), lead(2, assigned=None)])
    ch = spark.createDataFrame(
        [(1, 1, 9, "admin", 2, None), (1, 2, 9, "admin", 3, "x"), (1, 3, 9, "admin", 4, None),
         (2, 4, 9, "admin", 0, None), (2, 5, 9, "staff", 5, None)],
        "lead_pk BIGINT, seq BIGINT, actor_id BIGINT, role STRING, new_assignee BIGINT, notes STRING")
    res = M.apply_reassign(leads, ch, "2026-03-20 00:00:00")
    hist = sorted((r.assigned_from, r.assigned_to) for r in res["lead_assignments"].collect())
    assert hist == [(1, 2), (2, 3), (3, 4)]
    assert {r.id: r.assigned_to for r in res["leads"].collect()} == {1: 4, 2: None}
    rej = {r.seq: r.reason for r in res["rejects"].collect()}
    assert rej == {4: "assigned_to is required", 5: "Forbidden"}
    details = sorted(r.details for r in res["audit"].collect())
    assert details[0] == "Reassigned lead 1 from user 1 to 2"


def test_partial_update_absent_vs_null(spark):
    base = lead(1, status="New Lead")
    base = base[:4] + ("8000000000",) + base[5:]
    leads = df(spark, LEADS_DDL, [base, lead(2)])
    ch = spark.createDataFrame(
        [(1, 1, 0, ["alt_mobile"], None, None), (1, 2, 0, ["status"], "Lost", None)],
        "lead_pk BIGINT, seq BIGINT, actor_id BIGINT, fields ARRAY<STRING>, status STRING, "
        "alt_mobile STRING")
    out = {r.id: r for r in M.apply_lead_updates(leads, ch, "2026-03-20 00:00:00")["leads"].collect()}
    assert out[1].alt_mobile is None and out[1].status == "Lost"
    assert out[2].status == "New Lead"


def test_intake_rules_order(spark):
    users = df(spark, USERS_DDL, [(5, "u", "U", "staff", 1)])
    req = spark.createDataFrame(
        [(1, 5, None, "900", "2001-13-45", 0), (2, 5, "A", "900", "2001-13-45", 0),
         (3, 5, "B", "900", None, 0), (4, 5, "C", "900", "2001-02-03", 77), (5, 5, "D", "", None, None)],
        "request_id BIGINT, actor_id BIGINT, customer_name STRING, mobile STRING, "
        "travel_date STRING, assigned_to BIGINT")
    rej = {r.request_id: r.reject_reason for r in Q.lead_intake_rejects(req, users).collect()}
    assert rej == {1: Q.MSG_REQUIRED, 2: Q.MSG_TRAVEL_DATE, 4: Q.MSG_ASSIGNEE + "77", 5: Q.MSG_REQUIRED}
    good = Q.lead_intake_good(req, users, "2026-01-05").collect()
    assert [(g.request_id, g.assigned_to, g.hotel_category, g.status, g.enquiry_date) for g in good] == \
        [(3, 5, "Budget", "New Lead", dt.date(2026, 1, 5))]


def test_percent_half_up(spark):
    r = spark.range(1).select(N.percent(F.lit(1), F.lit(8)).alias("a"), N.percent(F.lit(1), F.lit(3)).alias("b"),
                              N.percent(F.lit(5), F.lit(0)).alias("c"),
                              N.average_rounded(F.lit(money(-2.5)), F.lit(1)).alias("d")).collect()[0]
    assert (r.a, r.b, r.c, r.d) == (13, 33, 0, -2)


def test_lead_document_parts_reassemble(spark):
    users, leads, conv, bookings, payments = _seed(spark)
    members = {"conversations": (conv, "lead_id", ["created_at", "id"], False)}
    docs = L3.document_parts(leads, users, members, part_size=2)
    c = docs.where(F.col("member") == "conversations").collect()
    assert len(c) >= 2 and all(len(r["items"]) <= 2 for r in c)
    ids = sorted(json.loads(x)["id"] for r in c for x in r["items"])
    assert ids == list(range(1, 8))
    assert docs.where(F.col("member") == "lead").count() == 2
    # The parts are the ordered list cut in order, for any part size.
    def lists(size):
        out = {}
        for r in sorted(L3.document_parts(leads, users, members, size).where("member = 'conversations'").collect(),
                        key=lambda r: (r.lead_pk, r.part)):
            out.setdefault(r.lead_pk, []).extend(r["items"])
        return out
    assert lists(2) == lists(3) == lists(1000)
    mine = L3.document_parts(leads, users, members, scope=F.col("assigned_to") == -1)
    assert mine.count() == 0


def test_small_parts_are_cut_from_grouped_lists(spark, monkeypatch):
    users, leads, conv, bookings, payments = _seed(spark)
    members = {"conversations": (conv, "lead_id", ["created_at", "id"], False), "bookings": (bookings, "lead_id", ["id"], True)}

    def parts(size):
        return sorted((r.lead_pk, r.member, r.part, r.parts, *r["items"]) for r in L3.document_parts(leads, users, members, size).collect())

    placed = []
    position = L3.ordered_position
    monkeypatch.setattr(L3, "ordered_position", lambda *a, **b: placed.append(1) or position(*a, **b))
    cut = {size: parts(size) for size in (1, 2, 3, 7, 8)}
    assert not placed                       # lists of seven are not moved to be placed, however small the parts
    assert [r[2:4] for r in cut[3] if r[1] == "conversations"] == [(0, 3), (1, 3), (2, 3)]
    monkeypatch.setattr(L3, "WHOLE_LIST", 3)
    assert {size: parts(size) for size in cut} == cut and len(placed) == 3


def test_with_previous_equals_lag_on_skewed_keys(spark):
    from wayline.operators.sequence import ordered_position, with_previous

    # key 0 holds a third of the rows; timestamps repeat so the id breaks ties
    data = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") % 500).alias("t"), F.col("id"), (F.col("id") * 13 % 101).alias("v"))
    got = with_previous(data, ["k"], ["t", "id"], ["v"], prefix="p_").select("id", "p_v", "has_prev")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = data.select("id", F.lag("v").over(w).alias("p_v"),
                       F.lag("id").over(w).isNotNull().alias("has_prev"))
    assert got.exceptAll(want).count() == 0 and got.count() == 6000
    pos = ordered_position(data, ["k"], ["t", "id"], n_ranges=16).select("id", "pos")
    rn = data.select("id", F.row_number().over(w).cast("bigint").alias("pos"))
    assert pos.exceptAll(rn).count() == 0


def test_package_update_overwrites_all_fields_and_create_appends(spark):
    p = df(spark, PACKAGES_DDL, [
        (1, 10, 2, "Old", '[{"day": 1, "description": "x"}]', "[]", '{"type": "SUV", "price": 5}', "[]",
         money(100), money(10)),
        (2, 11, 2, "Keep", "[]", "[]", "{}", "[]", money(50), money(0))])
    ch = spark.createDataFrame(
        [("update", 1, 1, 10, 3, "New", None), ("create", None, 2, 12, 3, "Fresh", [(1, "Day one")])],
        "op STRING, package_id BIGINT, seq BIGINT, lead_pk BIGINT, actor_id BIGINT, tour_name STRING, "
        "itinerary ARRAY<STRUCT<day: INT, description: STRING>>")
    out = {r.id: r for r in M.apply_packages(p, ch, "2026-03-01 00:00:00")["packages"].collect()}
    assert set(out) == {1, 2, 3}
    assert (out[1].tour_name, out[1].itinerary, out[1].transport, out[1].base_price) == \
        ("New", "[]", "{}", money(0))
    assert out[2].tour_name == "Keep" and out[2].base_price == money(50)
    assert out[3].lead_id == 12 and json.loads(out[3].itinerary) == [{"day": 1, "description": "Day one"}]


def test_notes_add_and_scoped_delete(spark):
    notes = spark.createDataFrame([], "id BIGINT, lead_id BIGINT, user_id BIGINT, note STRING, color STRING")
    adds = spark.createDataFrame([(1, 5, 7, "  hello ", None), (2, 5, 7, "   ", "green"), (3, 6, 8, "x", "green")],
                                 "id BIGINT, lead_pk BIGINT, actor_id BIGINT, note STRING, color STRING")
    dels = spark.createDataFrame([(1, 1, "staff", 7), (3, 2, "staff", 7), (99, 3, "admin", 1)],
                                 "note_id BIGINT, seq BIGINT, role STRING, actor_id BIGINT")
    res = M.apply_notes(notes, adds, dels)
    assert [(r.id, r.note, r.color) for r in res["lead_notes"].collect()] == [(3, "x", "green")]
    assert {r.request_key: r.reason for r in res["rejects"].collect()} == {3: "Forbidden", 99: "Not found"}
    assert [r.id for r in res["note_rejects"].collect()] == [2]


def test_category_upsert_and_cascade(spark):
    cats = df(spark, CATS_DDL, [(1, "A", 0, 1), (2, "B", 1, 1)])
    subs = df(spark, SUBS_DDL, [(10, 1, "s1", 1, 1, money(1), "", 0, 1), (11, 2, "s2", 1, 1, money(1), "", 0, 1)])
    ups = spark.createDataFrame([(2, "B1", 5, 0, 1), (2, "B2", 6, 0, 2), (3, "C", 0, 1, 3)],
                                "id BIGINT, name STRING, sort_order INT, is_active INT, seq BIGINT")
    dels = spark.createDataFrame([(1,)], "category_id BIGINT")
    res = M.apply_category_changes(cats, subs, ups, dels)
    assert {r.id: r.name for r in res["tour_categories"].collect()} == {2: "B2", 3: "C"}
    assert [r.id for r in res["tour_subcategories"].collect()] == [11]
    leads = df(spark, LEADS_DDL, [lead(1, cat=1), lead(2, cat=2)])
    assert [r.id for r in M.dangling_category_leads(leads, res["tour_categories"]).collect()] == [1]


def test_category_rules(spark):
    cats = spark.createDataFrame([(5, "A", "old", 3, 1)], "id BIGINT, name STRING, description STRING, sort_order INT, is_active INT")
    ups = spark.createDataFrame([(None, "  New ", 1, "admin"), (None, " ", 2, "admin"), (None, "X", 3, "staff"),
                                 (None, "Two", 4, "manager"), (5, "B", 5, "admin"), (5, "B", 5, "admin")],
                                "id BIGINT, name STRING, seq BIGINT, role STRING")
    dels = spark.createDataFrame([(5, 9, "staff")], "category_id BIGINT, seq BIGINT, role STRING")
    subs = df(spark, SUBS_DDL, [(10, 5, "s1", 1, 1, money(1), "", 0, 1)])
    res = M.apply_category_changes(cats, subs, ups, dels, "2026-03-01 00:00:00")
    assert sorted(tuple(r) for r in res["tour_categories"].collect()) == [
        (5, "B", "", 0, 1), (6, "New", "", 0, 1), (7, "Two", "", 0, 1)]
    assert {(r.seq, r.reason) for r in res["rejects"].collect()} == {(2, "Name required"), (3, "Forbidden"), (9, "Forbidden")}
    assert sorted(r.details for r in res["audit"].collect()) == ["Created tour category: New", "Created tour category: Two"]
    assert res["tour_subcategories"].count() == 1


def test_staff_cannot_trash_or_restore(spark):
    leads = df(spark, LEADS_DDL, [lead(1), lead(2, deleted=1)])
    ch = spark.createDataFrame([(1, 1, 7, "staff"), (1, 2, 8, "manager"), (2, 3, 7, None)],
                               "lead_pk BIGINT, seq BIGINT, actor_id BIGINT, role STRING")
    res = M.apply_soft_delete(leads, ch, "2026-03-01 00:00:00")
    assert {r.id: (r.is_deleted, r.deleted_by) for r in res["leads"].collect()} == {1: (1, 8), 2: (1, None)}
    assert {r.seq for r in res["rejects"].collect()} == {1, 3} and res["audit"].count() == 1
    res = M.apply_restore(leads, ch, "2026-03-01 00:00:00")
    assert {r.seq: r.reason for r in res["rejects"].collect()} == {1: "Forbidden", 3: "Forbidden", 2: "Not found or not deleted"}


def test_user_create_update_deactivate(spark):
    users = df(spark, USERS_DDL, [(2, "sa", "Staff A", "staff", 1), (3, "sb", "Staff B", "staff", 1)])
    creates = spark.createDataFrame([(5, "new", "New Person", None)],
                                    "id BIGINT, username STRING, full_name STRING, role STRING")
    updates = spark.createDataFrame([(2, 1, ["full_name"], "Renamed", None), (2, 2, ["role"], None, "manager")],
                                    "user_pk BIGINT, seq BIGINT, fields ARRAY<STRING>, full_name STRING, "
                                    "role STRING")
    deact = spark.createDataFrame([(3,)], "user_pk BIGINT")
    out = {r.id: r for r in M.apply_user_changes(users, creates, updates, deact)["users"].collect()}
    assert (out[5].role, out[5].is_active) == ("staff", 1)
    assert (out[2].full_name, out[2].role) == ("Renamed", "manager")
    assert out[3].is_active == 0 and out[3].full_name == "Staff B"


def test_whatsapp_messages_are_stripped(spark):
    ch = spark.createDataFrame([(1, 7, "  hi there\n", 1), (1, 7, "   ", 2), (2, 7, None, 3)],
                               "lead_pk BIGINT, actor_id BIGINT, message STRING, seq BIGINT")
    res = M.apply_whatsapp(ch, "2026-03-01 00:00:00")
    assert [r.message for r in res["whatsapp_logs_new"].collect()] == ["hi there"]
    assert sorted(r.seq for r in res["rejects"].collect()) == [2, 3]
    assert [r.details for r in res["audit"].collect()] == ["WhatsApp logged for lead 1"]


def split_table(spark, src, out, n=4):
    """The events table as ``n`` files that arrive in reverse time order."""
    import time

    import pyarrow.parquet as pq

    rows = pq.read_table(src).sort_by([("ts", "descending")])
    out.mkdir(parents=True)
    size = -(-len(rows) // n)
    for i in range(n):
        pq.write_table(rows.slice(i * size, size), str(out / f"part-{i}.parquet"))
        time.sleep(1.1)          # the file source takes files in modification order


def test_conversation_stream_over_a_split_table_and_a_rerun(spark, tmp_path):
    from wayline.sources.views import Tables
    from wayline.streaming import change_stream as CS
    from wayline.streaming.files import stream_table

    sf = "/root/testdata/sf0.001"
    t = Tables.of(spark, sf)
    split_table(spark, f"{sf}/events.parquet", tmp_path / "events.parquet")
    out = str(tmp_path / "out")

    def run():
        events = stream_table(spark, str(tmp_path / "events.parquet"), t.base("events").schema, 1)
        req = CS.conversation_requests(events, t.row_count("customer"), t.row_count("supplier"))
        CS.run_conversation_stream(spark, req, t.leads, out, str(tmp_path / "ck"), "2024-01-20 00:00:00")

    run()
    first = CS.read_output(spark, out, "followups").count()
    run()  # same checkpoint: nothing new to process
    assert CS.read_output(spark, out, "followups").count() == first == t.followups.count() > 0
    for name in CS.OUTPUTS:
        CS.read_output(spark, out, name)
    changes = CS.read_output(spark, out, "lead_status_changes")
    assert changes.where("status is null or status = ''").count() == 0
    last = {}
    for r in sorted(changes.collect(), key=lambda r: r.seq):
        last[r.lead_id] = r.status
    got = {r.id: r.status for r in CS.current_status(t.leads, changes).select("id", "status").collect()}
    assert last and all(got[k] == v for k, v in last.items())


def test_tumbling_counts_do_not_depend_on_files_or_their_order(spark, tmp_path):
    from wayline.streaming import audit_counts as A

    sf = "/root/testdata/sf0.001"
    split_table(spark, f"{sf}/events.parquet", tmp_path / "data" / "events.parquet")

    def rows(df):
        return sorted(map(tuple, df.select("window_start", "window_end", "action", "cnt").collect()))

    got = []
    for i, (folder, files) in enumerate(((sf, 8), (str(tmp_path / "data"), 1))):
        out = str(tmp_path / f"out{i}")
        A.run_counts(A.audit_stream(spark, folder, files), out, str(tmp_path / f"ck{i}"))
        got.append(rows(A.final_counts(spark, out)))
    assert got[0] == got[1] and sum(r[3] for r in got[0]) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_no_local_scratch_off_local_masters():
    from wayline.session import local_scratch

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            local_scratch(master)
    assert local_scratch("local[4]") and local_scratch("local")


def test_equal_requests_take_effect_once(spark):
    leads = df(spark, LEADS_DDL, [lead(1), lead(2)])
    ch = spark.createDataFrame([(1, 5, 7, "admin"), (1, 5, 7, "admin"), (1, 5, 8, "admin"), (2, 9, 7, "admin")],
                               "lead_pk BIGINT, seq BIGINT, actor_id BIGINT, role STRING")
    marked = M.first_per_key(ch, "lead_pk").collect()
    assert len(marked) == 4 and sum(r._first for r in marked) == 2
    res = M.apply_soft_delete(leads, ch, "2026-03-01 00:00:00")
    out = res["leads"].collect()
    assert sorted(r.id for r in out) == [1, 2] and all(r.is_deleted == 1 for r in out)
    assert res["rejects"].count() == 2


def test_a_payment_sent_twice_counts_once_and_gets_defaults(spark):
    bookings = spark.createDataFrame([(1, 100, 0, 100)], "id BIGINT, final_amount INT, advance_paid INT, balance INT")
    pay = "payment_id BIGINT, booking_id BIGINT, amount DECIMAL(10,2), payment_method STRING, payment_date DATE, reference_no STRING, notes STRING"
    ch = spark.createDataFrame([(9, 1, 5, 1, 7), (9, 1, 5, 1, 7), (9, 1, 6, 2, 7), (None, 1, 2, 3, 7), (None, 1, 2, 3, 7), (4, 8, 1, 4, 7)],
                               "payment_id BIGINT, booking_id BIGINT, amount INT, seq BIGINT, actor_id BIGINT")
    res = M.apply_payments(bookings, spark.createDataFrame([], pay), ch, "2026-03-01 00:00:00")
    rows = res["payments"].collect()
    assert sorted(float(r.amount) for r in rows) == [2.0, 2.0, 5.0]
    assert {(r.payment_method, str(r.payment_date), r.reference_no, r.notes) for r in rows} == {("Cash", "2026-03-01", "", "")}
    assert float(res["bookings"].first().advance_paid) == 9.0 and res["rejects"].count() == 1


def test_payments_recompute_touched_bookings_only(spark):
    bookings = spark.createDataFrame([(1, 100, 1, 2), (2, 200, 3, 4), (2, 300, 5, 6), (3, 50, 7, 8), (None, 10, 9, 9)],
                                     "id BIGINT, final_amount INT, advance_paid INT, balance INT")
    pay = spark.createDataFrame([(1, money(10)), (2, money(20)), (3, money(30)), (None, money(40))], "booking_id BIGINT, amount DECIMAL(10,2)")
    ch = spark.createDataFrame([(1, None, 1, 7), (2, 5, 2, 7), (9, 6, 3, 7), (None, 8, 4, 7)],
                               "booking_id BIGINT, amount INT, seq BIGINT, actor_id BIGINT")
    res = M.apply_payments(bookings, pay, ch, "2026-03-01 00:00:00")
    # 1 is touched by a payment without an amount; 2 is stored twice, so its new payment is found twice; 3 and NULL keep their values
    assert sorted(((r.id or 0, float(r.advance_paid), float(r.balance)) for r in res["bookings"].collect())) == [
        (0, 9.0, 9.0), (1, 10.0, 90.0), (2, 30.0, 170.0), (2, 30.0, 270.0), (3, 7.0, 8.0)]
    assert res["rejects"].count() == 2


def test_latest_request_by_seq_sets_the_status_and_followups_get_ids(spark):
    leads = df(spark, LEADS_DDL, [lead(1)])
    old, new = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    ch = spark.createDataFrame(
        [(50, 1, 1, 7, "x", "Interested", "Outgoing", dt.date(2026, 3, 1), new, "Lost"),
         (60, 2, 1, 7, "y", "Other", "Outgoing", dt.date(2026, 3, 2), old, "Booked"),
         (70, 3, 1, 7, "z", "Other", "Outgoing", None, old, "")],
        "conv_id BIGINT, seq BIGINT, lead_pk BIGINT, actor_id BIGINT, summary STRING, call_result STRING, call_type STRING, "
        "next_followup_date DATE, created_at TIMESTAMP_NTZ, status_update STRING")
    stored = df(spark, FOLLOWUPS_DDL, [(300, 1, 7, dt.date(2026, 1, 1), "Pending", old)])
    res = M.apply_conversations(leads, ch, "2026-03-01 00:00:00", stored)
    assert res["leads"].first().status == "Booked"           # a back-dated request is still the later one
    assert sorted((r.id, r.notes) for r in res["followups"].collect()) == [(301, "x"), (302, "y")]


def test_csv_text_round_trip(spark, tmp_path):
    from wayline.sources import io

    rows = [(1, 'say "hi"\nthere', " x ", dt.datetime(2024, 1, 2, 3, 4, 5, 123456)), (2, "", None, None),
            (3, None, "a,b\r\nc\\", dt.datetime(2024, 1, 2, 3, 4, 5)), (4, '\\"', '"', None)]
    t = spark.createDataFrame(rows, "id BIGINT, a STRING, b STRING, ts TIMESTAMP_NTZ")
    io.write_csv(t, str(tmp_path / "x"))
    assert sorted(tuple(r)[:4] for r in io.load_typed(spark, str(tmp_path / "x"), t.schema).collect()) == rows
    texts = "".join(open(f, newline="").read() for f in (tmp_path / "x").glob("*.csv"))
    assert '"say ""hi""\nthere"' in texts and '""""' in texts


def test_strip_like_python(spark):
    from wayline.functions.predicates import py_strip

    blanks = [" ", "\t", "\n", "\x1c", "\x1f", "\x85", "\u00a0", "\u2003", "\u3000", "\u2028"]
    texts = [b + "a b" + b + b for b in blanks] + ["".join(blanks), "", "\u200bx\u200b", "x\n"]
    t = spark.createDataFrame([(x,) for x in texts], "s STRING")
    assert [r.p for r in t.select(py_strip(t.s).alias("p")).collect()] == [x.strip() for x in texts]


def test_blank_search_finds_nothing(spark):
    from wayline.operators.lists import lead_search

    leads = df(spark, LEADS_DDL, [lead(1), lead(2)])
    assert lead_search(leads, " \u3000").count() == 0 and lead_search(leads, "cust").count() == 2


def test_wildcard_search_folds_all_of_unicode(spark):
    names = ["Nguyễn Văn", "NGUYE\u0302\u0303N", "Άννα", "Ёлка", "plain"]
    t = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id BIGINT, customer_name STRING")
    for text, want in (("nguyen", {0, 1}), ("ng_yen", {0, 1}), ("αννα", {2}), ("елка", {3}), ("NGUYỄN", {0, 1}), ("plain", {4})):
        assert {r.id for r in t.where(like_any(["customer_name"], text)).collect()} == want, text


def test_positions_of_sparse_and_negative_keys(spark):
    from wayline.operators.sequence import position_within

    keys = [k * 10**9 for k in range(-300, 300)] + [2**62, -2**62, 7, 8, 9]
    t = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in keys], "g INT, k BIGINT")
    w = Window.partitionBy("g").orderBy("k")
    want = t.select("g", "k", F.row_number().over(w).cast("bigint").alias("pos"))
    for n in (None, 40):
        got = position_within(t, "g", "k", n_ranges=n)
        assert got.exceptAll(want).count() == 0 and got.count() == len(keys)
