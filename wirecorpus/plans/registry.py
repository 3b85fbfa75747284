"""Queries by name, each with the SQL an independent engine can answer it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query; ``sql`` is None where the result is not expressible as one statement."""
        def keep(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} registered twice")
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query
        return keep


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("'", "''") + "'"
