"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under its name, with SQL that gives the same rows if there is any."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add

    def also(self, name: str, other: str) -> None:
        """Keeps a query under a second name, by which it was known before."""
        self.queries[other] = self.queries[name]
        if name in self.sql:
            self.sql[other] = self.sql[name]
