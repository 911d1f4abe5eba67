"""Collects the queries and their reference SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @functools.wraps(f)
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, sf_dir)

            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return f

        return register
