"""Pairs of rows by blocks of rows: rows and pairs of blocks are moved, pairs of rows come up only where they are given out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that are handed over together, as one array.
BLOCK = 256


def blocks(rows: DataFrame, by: list[str], *facts: str, order: str = "ord") -> DataFrame:
    """by, block (from 0) and members: arrays of (order, facts) of at most BLOCK rows alike in by, in that order; a later block's rows come after an earlier one's."""
    at = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("block", F.floor((at - 1) / BLOCK)).groupBy(*by, "block").agg(F.sort_array(F.collect_list(F.struct(order, *facts))).alias("members"))


def dealt(met: DataFrame, *by: str | Column) -> DataFrame:
    """met over as many tasks as a shuffle has, however small it is: few pairs of blocks stand for many of rows."""
    return met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def spread(met: DataFrame, x: str, y: str) -> DataFrame:
    """met with a row for each two members of its arrays x and y, as columns of these names."""
    return met.withColumn(x, F.explode(x)).withColumn(y, F.explode(y))
