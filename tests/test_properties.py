"""Properties over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from wayline.operators import changes as M
from wayline.operators import lists as L
from wayline.operators import reports as R
from wayline.plans import params as P
from wayline.plans.catalog_changes import soft_delete_changes
from wayline.sources.views import Tables


def test_bucket_counts_sum_to_pending(spark):
    t = Tables.of(spark, SF01)
    buckets = R.followup_bucket_counts(t.followups, P.FOLLOWUP_AS_OF).agg(F.sum("cnt")).collect()[0][0]
    assert buckets == t.followups.where(F.col("status") == "Pending").count()


def test_status_counts_sum_to_leads(spark):
    t = Tables.of(spark, SF01)
    assert R.lead_status_counts(t.leads).agg(F.sum("cnt")).collect()[0][0] == t.leads.count()


def test_pages_concatenate_to_full_sort(spark):
    t = Tables.of(spark, SF01)
    kw = dict(role="admin", assigned=P.FILTER_ASSIGNEE, status=P.FILTER_STATUS)
    full = [r.id for r in L.lead_list(t.leads, t.users, page_no=None, **kw).collect()]
    pages, n = [], 1
    while True:
        ids = [r.id for r in L.lead_list(t.leads, t.users, page_no=n, per_page=5, **kw).collect()]
        if not ids:
            break
        pages += ids
        n += 1
    assert pages == full and len(full) > 5


def test_soft_delete_then_restore_is_identity_on_live_leads(spark):
    t = Tables.of(spark, SF01)
    live_changes = soft_delete_changes(t).join(
        t.leads.where("is_deleted = 0").select(F.col("id").alias("_l")), F.col("lead_pk") == F.col("_l"),
        "left_semi")
    deleted = M.apply_soft_delete(t.leads, live_changes, P.AS_OF)["leads"]
    restored = M.apply_restore(deleted, live_changes, P.AS_OF)["leads"]
    cols = ["id", "is_deleted", "deleted_at", "deleted_by"]
    assert restored.select(*cols).exceptAll(t.leads.select(*cols)).count() == 0


def test_payments_replayed_by_id_change_nothing(spark):
    t = Tables.of(spark, SF01)
    pays = t.payments.withColumn("payment_id", F.monotonically_increasing_id())
    pays = spark.createDataFrame(pays.collect(), pays.schema)  # fix the ids
    early = pays.where("payment_date < DATE'1999-01-01'")
    late = pays.where("payment_date >= DATE'1999-01-01'").withColumn("seq", F.lit(0))
    b0 = t.bookings.withColumn("advance_paid", F.lit(0).cast("decimal(18,2)")) \
                   .withColumn("balance", F.col("final_amount").cast("decimal(18,2)"))
    once = M.apply_payments(b0, early, late, P.AS_OF)
    twice = M.apply_payments(once["bookings"], once["payments"], late, P.AS_OF)
    assert twice["payments"].count() == once["payments"].count()
    cols = ["id", "advance_paid", "balance"]
    assert once["bookings"].select(*cols).exceptAll(twice["bookings"].select(*cols)).count() == 0


def test_hard_delete_leaves_no_children(spark):
    t = Tables.of(spark, SF01)
    tables = {"leads": t.leads, "followups": t.followups, "conversations": t.conversations,
              "packages": t.packages, "whatsapp_logs": t.whatsapp_logs, "lead_notes": t.lead_notes,
              "bookings": t.bookings, "payments": t.payments}
    changes = t.leads.where("is_deleted = 1").select(
        F.col("id").alias("lead_pk"), F.col("id").alias("seq"), F.lit(0).alias("actor_id"),
        F.lit("admin").alias("role"))
    res = M.apply_hard_delete(tables, changes, P.AS_OF)
    gone = res["_gone"]
    for name in ("followups", "conversations", "packages", "whatsapp_logs", "lead_notes", "bookings"):
        assert res[name].join(gone, F.col("lead_id") == F.col("_gone"), "left_semi").count() == 0
    assert res["leads"].where("is_deleted = 1").count() == 0
    kept_bookings = res["bookings"].select(F.col("id").alias("_b"))
    orphan = res["payments"].join(kept_bookings, F.col("booking_id") == F.col("_b"), "left_anti")
    all_bookings = t.bookings.select(F.col("id").alias("_b"))
    assert orphan.join(all_bookings, F.col("booking_id") == F.col("_b"), "left_semi").count() == 0


def test_replayed_batch_replaces_its_folder(spark, tmp_path):
    from wayline.streaming.files import read_batches, write_batch

    rows, root = spark.range(5), str(tmp_path / "out")
    write_batch(rows, root, "t", 0)
    write_batch(rows, root, "t", 0)
    assert read_batches(spark, root, "t").count() == 5
    write_batch(rows, root, "t", 1)
    assert read_batches(spark, root, "t").count() == 10
    assert read_batches(spark, root, "none", rows.schema).count() == 0


def test_load_typed_keeps_corrupt_rows(spark, tmp_path):
    from pyspark.sql import types as T

    from wayline.sources.io import CORRUPT, load_typed

    p = tmp_path / "in.csv"
    p.write_text("id,amount\n1,10.50\nx,2.00\n3,4.25\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.DecimalType(10, 2))])
    df = load_typed(spark, str(p), schema, "csv").cache()
    assert df.count() == 3
    bad = df.where(F.col(CORRUPT).isNotNull()).collect()
    assert len(bad) == 1 and bad[0]["id"] is None


def test_lead_documents_hold_every_child(spark):
    from wayline.plans.registry import queries

    q = queries()
    docs = q["lead_360"](spark, SF01)
    got = (docs.where(F.col("member") != "lead")
           .groupBy("lead_pk", "member")
           .agg(F.sum(F.json_array_length("items")).cast("bigint").alias("n")))
    counts = q["lead_360_counts"](spark, SF01)
    members = ["conversations", "followups", "packages", "bookings", "payments",
               "whatsapp_logs", "pinned_notes", "history"]
    stack = ", ".join(f"'{m}', n_{m}" for m in members)
    want = (counts.selectExpr("id AS lead_pk", f"stack({len(members)}, {stack}) AS (member, n)")
            .where("n > 0"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert docs.where(F.col("member") == "lead").count() == counts.count()


def test_like_regex_equals_spark_ilike_on_folded_text(spark):
    # The accent-aware regex must accept exactly what Spark's ILIKE accepts
    # once accents are folded, wildcards and backslash escapes included.
    import random

    from wayline.functions.predicates import FOLD_FROM, FOLD_TO, like_regex

    rnd = random.Random(7)
    chars = list("aAeEéÉèoOöÖñNxy1 .*[]()^$|?+{}#-") + ["\n"]
    pat_atoms = chars + ["%", "_", "\\%", "\\_", "\\\\"]
    rows = []
    for _ in range(400):
        text = "".join(rnd.choice(chars + ["%", "_", "\\"]) for _ in range(rnd.randint(0, 8)))
        pattern = "".join(rnd.choice(pat_atoms) for _ in range(rnd.randint(0, 5)))
        if rnd.random() < 0.5:  # also patterns cut from the text itself, so many rows match
            a = rnd.randint(0, len(text))
            piece = text[a:a + 3].replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            pattern = f"%{piece}%"
        rows.append((text, pattern, like_regex(pattern)))
    d = spark.createDataFrame(rows, "s string, p string, rx string")
    want = F.expr(f"translate(s, '{FOLD_FROM}', '{FOLD_TO}') ILIKE translate(p, '{FOLD_FROM}', '{FOLD_TO}')")
    checked = d.select("s", "p", F.expr("s RLIKE rx").alias("got"), want.alias("want"))
    bad = checked.where(F.col("got") != F.col("want")).collect()
    assert not bad, bad[:5]
    assert checked.where("want").count() > 50


def test_queries_on_materialized_views_match(spark, tmp_path):
    from wayline.plans.registry import REGISTRY, queries

    queries()  # loads the catalogs
    t = Tables.of(spark, SF001)
    stored = t.materialize(str(tmp_path / "crm"))
    for name in ("staff_performance", "customer_history_top5", "lead_list_page", "category_tree",
                 "booking_balances", "apply_bookings", "lead_360_counts", "package_price_check"):
        a = REGISTRY[name].fn(t)
        b = REGISTRY[name].fn(stored)
        assert a.schema.simpleString() == b.schema.simpleString(), name  # Parquet reads are nullable
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
