"""Every registered query against its DuckDB oracle at sf0.01 (the correctness gate)."""

from __future__ import annotations

import pytest

from tests.conftest import SF001, SF01
from wayline.plans.oracle_check import compare
from wayline.plans.registry import oracle_sql, queries

QUERIES = queries()
ORACLES = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    r = compare(QUERIES[name](spark, SF01), duck, ORACLES[name])
    assert r["columns_match"], (r["spark_cols"], r["oracle_cols"])
    assert r["spark_rows"] == r["oracle_rows"]
    assert r["values_match"], (r.get("only_spark"), r.get("only_oracle"))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "revenue" in df.columns


def test_every_query_runs_at_smallest_scale(spark):
    # Schemas stay stable across scales (same columns at sf0.001 and sf0.01).
    for name in ("staff_performance", "customer_history_top5", "apply_bookings"):
        a = QUERIES[name](spark, SF001)
        b = QUERIES[name](spark, SF01)
        assert a.schema == b.schema
