"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from myospark.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least of a vertex's neighbourhood: the larger ones, or the smaller ones and itself.

    A hub's neighbours share a key of the join, which nothing but another shuffle follows, so adaptive execution splits it: an edge is
    16 bytes, so a hub of a million neighbours is 16 MB, and partitions above the session's skew threshold are cut.
    """
    both = edges.union(edges.select("b", "a")) if large else edges
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    out = near.where(F.col("v") > F.col("u")) if large else near.union(least.select("u", F.col("u").alias("v"), "m"))
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(vertex, root) of all vertices in edges (a, b); root is the least vertex of the component.

    Each round is cut off by a checkpoint; the edges always point from larger to smaller vertices. Rounds grow with
    the logarithm of the longest chain.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    total = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = total(edges)
    while was[0]:
        edges = cut(_star(_star(edges, True), False))
        now = total(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct()
