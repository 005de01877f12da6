"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.runtime import configure, table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Lazy scans of one input folder, by table name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Block:
    """The queries of one block of the catalogue."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of Tables under its own name, with the SQL that gives the same rows."""

        def add(build: Callable[[Tables], DataFrame]) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(Tables(configure(spark), sf_dir))

            run.__name__, run.__doc__ = build.__name__, build.__doc__
            self.queries[build.__name__] = run
            if sql is not None:
                self.oracle[build.__name__] = sql
            return run

        return add
