from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.llm.conftest import prose, vocabulary
from wayline.llm import op3_quality as op


def table(spark, docs):
    return {r.doc_id: r for r in op.assess(docs).collect()}


def test_boilerplate_lines_go_and_depleted_documents_fail(spark, docs_of):
    rng = random.Random(2)
    words = vocabulary(rng)
    menu = "Home  products about contact imprint news jobs press"
    foot = "terms privacy cookies sitemap login register help legal"
    rows = [(i, f"{prose(rng, words, 40)}\n  {menu.upper() if i % 2 else menu} \n{foot}") for i in range(12)]
    rows += [(100, f"{prose(rng, words, 12)}\n{menu}\n{foot}"), (101, prose(rng, words, 20))]
    rows += [(200 + i, f"{prose(rng, words, 40)}\n{menu}") for i in range(5)]
    docs = docs_of(rows[:14]).union(docs_of(rows[14:], source="other"))
    got = table(spark, docs)
    assert all(got[i].kept and got[i].n_lost_words == 16 and menu not in got[i].clean_text.lower() for i in range(12))
    assert not got[100].kept and not got[100].base_failed and got[100].n_lost_words == 16
    assert got[101].kept and got[101].n_lost_words == 0
    assert all(got[200 + i].n_lost_words == 0 for i in range(5))            # too few documents of that host


def test_exact_copies_count_once(spark, docs_of):
    rng = random.Random(3)
    words = vocabulary(rng)
    text = "\n".join(prose(rng, words, 20) for _ in range(3))
    got = table(spark, docs_of([(i, text) for i in range(50)] + [(60, prose(rng, words, 30))]))
    assert all(got[i].kept and got[i].n_lost_words == 0 for i in range(50))


def test_repeated_windows_by_brute_force(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = table(spark, docs_of(rows))
    for i, text in rows:
        ws = text.split()
        grams = [tuple(ws[j:j + 5]) for j in range(max(0, len(ws) - 4))]
        covered = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert got[i].n_repeat_words == len(covered)
        assert got[i].base_failed == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws))


def test_edges(spark, docs_of):
    rows = [(1, None, "en", None, None), (2, "", "en", None, 0), (3, " \n\t", "en", "s", 3),
            (4, "word " * 50_000, "en", "s", 1), (None, "one two three four five six seven eight nine ten eleven", "en", "s", 1),
            (5, "a # $\na # $\n\na # $", "en", "s", 1), (5, "a # $\na # $\n\na # $", "en", "s", 1)]
    docs = docs_of(rows).withColumn("kept", F.lit(3)).withColumn("n_words", F.lit("x")).withColumn("_t", F.lit(1))
    got = op.assess(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].kept == 3 and by[1].kept_ is False and by[1].clean_text is None and by[2].n_words_ == 0
    assert by[4].n_words_ == 50_000 and by[4].n_repeat_words == 50_000 and by[4].base_failed
    assert by[None].kept_ and by[None].n_words_ == 11
    assert by[5].n_dup_lines == 2 and by[5].n_symbols == 6 and by[5].word_chars == 9
    assert op.assess(docs.limit(0)).count() == 0


def test_keep_good_returns_the_columns(spark, docs_of):
    docs = docs_of([(1, "one two three four five six seven eight nine ten"), (2, "short")])
    out = op.keep_good(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_native_plan(spark, docs_of):
    plan = op.assess(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
