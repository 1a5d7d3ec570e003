"""How queries are registered: a name, a function of (spark, folder), and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers a function of a table reader; ``sql`` is the same in DuckDB."""

        def wrap(f: Callable):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = query
            if sql:
                self.sql[f.__name__] = sql
            return f

        return wrap
