"""Queries with SQL against DuckDB, and every query on the smallest data."""

from __future__ import annotations

import pytest

from tests.conftest import SF001, SF01
from wayline.llm.queries import ORACLES, QUERIES
from wayline.plans.oracle_check import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    r = compare(QUERIES[name](spark, SF01), duck, ORACLES[name])
    assert r["columns_match"], (r["spark_cols"], r["oracle_cols"])
    assert r["spark_rows"] == r["oracle_rows"] > 0
    assert r["values_match"], (r.get("only_spark"), r.get("only_oracle"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_its_whole_table(spark, name):
    rows = QUERIES[name](spark, SF001).count()
    whole = spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert rows > 0 if name.startswith("op1_") else rows >= whole


def test_entry_registers_all_and_the_pipeline():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {q.split("_")[0] + "_" for q in names}
    assert "pipeline" in names
    assert set(ORACLES) <= set(e.oracle_sql()) <= names
