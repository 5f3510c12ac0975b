"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reachable.

    Large-star and small-star rounds alternate until no edge changes: each node
    links its larger, then its smaller, neighbours to the smallest one it knows.
    A round is one map-side combined aggregation and one join; its edges are a
    written table.  The number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        # pairs (u, v): v is a neighbour of u
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(least, "u")
        if larger:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True)
        small = star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        before, edges = edges, stored(small, "edges")
        discard(before)
        # A round that changes no edge is the last; equal counts and sums of hashes tell.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
