"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, staged


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of links (a, b: long, not null).

    Large-star and small-star rounds (Kiveris et al., 2014): each hangs the larger neighbours of a node, then the smaller
    ones, to the smallest, until every component is a star; the number of rounds grows with the logarithm of a component.
    The minimum of a node's neighbours is a table of its own before it is joined, so that a hub's links can be split.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        lower = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        forget(edges, least, large, lower)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
