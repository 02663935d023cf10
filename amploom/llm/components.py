"""Connected components of a link table, as a distributed computation: no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id that links lead to.

    Alternating large-star and small-star steps: each keeps the components, and the links become stars around
    the smallest ids after about log(longest path) rounds. Every step is an aggregation by id with partial
    minima and an equi-join, so a hub with very many links is reduced before it is shuffled.
    """
    edges = settle(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("u <> m").select("u", F.col("m").alias("v")) if not large else None
        return (moved if own is None else moved.union(own)).where("u <> v").distinct()

    while True:
        after = settle(star(star(edges, True), False), "links")
        stats = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (edges, after)]
        if stats[0] == stats[1]:
            break
        edges = after
    return after.select(F.col("u").alias("id"), F.col("v").alias("component")).union(after.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
