"""Where queries are listed: each a function of views, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import VIEWS, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Lists a function of the named views or tables."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) if v in VIEWS else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add
