"""Registered queries over the driver's tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL for those that have it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def registry() -> Registry:
    from tracemill.queries import explore, features, ingest, models, sequences, stores, streams, templates

    merged = Registry()
    for module in (ingest, templates, sequences, features, explore, models, stores, streams):
        merged.queries.update(module.REGISTRY.queries)
        merged.sql.update(module.REGISTRY.sql)
    return merged
