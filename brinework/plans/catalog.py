"""Registering queries with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import load


class Tables:
    """Tables of one directory as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


class Catalog:
    """Queries of one module; ``@catalog.query(sql)`` registers a function of ``Tables``."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def register(run: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[run.__name__] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
            if sql:
                self.oracles[run.__name__] = sql
            return run

        return register
