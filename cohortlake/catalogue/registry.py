"""Where query modules register a Spark query and, where SQL can say it, its check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlake import settings
from cohortlake.catalogue.ctes import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(settings.apply(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql)
        return fn

    return register
