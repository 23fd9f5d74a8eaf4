"""Every query of the library outside its optional subpackage, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "usage_window_stats"
MODULES = ("usage", "text", "learning", "windows", "joins", "retrieval", "reports", "experiments", "monitors", "streams", "routing", "source", "upkeep", "logs")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and the SQL that gives the same rows where there is one."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")
