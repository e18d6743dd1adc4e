"""Registered queries: each operator on the supplied tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

AREAS = ["scalars", "timeline", "spatial", "detection", "plots", "tracks", "traits", "rasters",
         "registry", "sources", "streams"]


class Workload:
    """Queries and SQL of one area, filled by the ``query`` decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All registered queries and their SQL."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for area in AREAS:
        work: Workload = import_module(f"furrow.workloads.{area}").work
        queries.update(work.queries)
        sql.update(work.sql)
    return queries, sql
