"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import materialise


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node of each neighbourhood; `large` moves greater
    neighbours, otherwise smaller ones and the node itself. Components stay as they are."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every node that has links, except the smallest of its component, with that smallest.

    Alternates large and small stars until nothing changes; each round is written to the shared
    folder. Nulls and links of a node to itself are ignored.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now, before = materialise(ordered.distinct(), "links"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now
        before = state
        now = materialise(_stars(materialise(_stars(now, True), "links"), False), "links")
