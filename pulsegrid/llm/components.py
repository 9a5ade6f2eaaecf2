"""Connected components of undirected links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected(links: DataFrame, ws: Workspace, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """``(node, component)`` of every node of ``links``: component is its smallest node.

    Alternating large-star and small-star rounds, each a pair of groupings: a node's
    larger neighbours, then its smaller ones, are hung on its smallest one. Depth falls
    by about half a round, so rounds are few; the result of each is a stored table. A
    hub's star is re-hung by a join on the hub, never gathered as one list.
    """
    edges = ws.table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), f"{name}-0")
    before, i = None, 0
    while True:
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself).
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        i += 1
        after = ws.table(small, f"{name}-{i}")
        if i > 1:
            ws.drop(f"{name}-{i - 2}")
        # Stars don't change any more when the sums of what they hold don't.
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before, edges = tuple(now), after
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
