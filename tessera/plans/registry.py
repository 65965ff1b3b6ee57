"""All queries of the library (without the optional subpackage) and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under a name, with its SQL oracle if there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from tessera.plans import (  # noqa: E402,F401
    ae_queries, class_queries, label_queries, matching_queries, misc_queries, picker_queries, pk_queries, risk_queries, search_queries, standard_queries, table_queries, validation_queries,
)
