"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``fn(tables) -> DataFrame`` over the CRM views of one
data folder.  Its oracle, when it has one, is SQL over the ``crm_*`` view
names; the view CTEs are prefixed automatically.  Queries without an oracle
(iterative or write-and-read-back operators) are checked against rows only
and have their own unit tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wayline.sources.views import Tables, oracle_with


@dataclass
class Entry:
    name: str
    fn: Callable[[Tables], DataFrame]
    oracle: str | None
    family: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None, family: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, family)
        return fn
    return deco


def _load_all() -> None:
    # Importing the catalog modules fills REGISTRY.
    from wayline.plans import (  # noqa: F401
        catalog_changes, catalog_lists, catalog_nested, catalog_quality, catalog_records,
        catalog_reports, catalog_requests, catalog_sources,
        catalog_streams)


def run(name: str, spark: SparkSession, data_dir: str) -> DataFrame:
    _load_all()
    return REGISTRY[name].fn(Tables.of(spark, data_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {n: (lambda spark, d, _e=e: _e.fn(Tables.of(spark, d))) for n, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: oracle_with(e.oracle) for n, e in REGISTRY.items() if e.oracle}
