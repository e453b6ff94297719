"""Connected components of a links table by alternating large and small stars.

Every round hooks each node's larger neighbours to its smallest one (large
star), then its smaller neighbours and itself (small star); the number of edges
never grows and stars around the smallest node of each component remain after
a number of rounds logarithmic in the component's size (Kiveris et al.,
"Connected components in MapReduce and beyond", 2014). Minima are aggregated
before the shuffle, no neighbour list is ever collected, and each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import materialise


def _hook(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        return out.distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node in ``links`` (columns a, b; long).

    Self-links and nulls add nothing; an empty table gives no rows.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "links")
    seen = None
    while True:
        e = materialise(_hook(_hook(e, True), False), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
