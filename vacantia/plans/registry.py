"""The catalogue of registered queries and the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.plans.standins import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES = ("market", "workload", "quality", "texts", "matching", "vectors", "streams", "reports", "fields", "stages")


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under its function's name; ``sql`` may name the stand-in relations."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = with_ctes(sql)
        return query

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"vacantia.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
