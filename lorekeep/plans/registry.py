"""Registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "j7_near_duplicates"
#: Modules of this package that register queries.
MODULES = ("pages", "lineage", "graphs", "search", "evaluation", "windows", "texts", "loads", "audits", "governance", "rules", "documents", "traces", "streams", "influence", "ontology", "excerpts", "transfers", "changes", "tasks")

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL twin where there is one."""

    def register(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql is not None:
            _sql[function.__name__] = sql
        return function

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lorekeep.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
