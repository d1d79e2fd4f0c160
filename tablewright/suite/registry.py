"""Named queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return keep

    def include(self, *others: "Suite") -> None:
        for other in others:
            for name, fn in other.queries.items():
                self.query(name, other.oracles.get(name))(fn)
