"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; each has the SQL that gives the same rows, or none."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Registers a function of t, where t(name) is a table."""

        def put(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is taken")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda n: table(spark, sf_dir, n))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return f

        return put
