"""Connected components of a table of links, by alternating large and small stars.

Every step links nodes to the smallest neighbour they know, with partial minima and joins only; no group of
neighbours is ever gathered. Steps are settled in the shared folder and repeat until nothing changes, which
takes a number of steps that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _step(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = _smallest(large)
    joined = large.join(least, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())


def components(links: DataFrame) -> DataFrame:
    """``(u, v)``: every linked node but the smallest, with the smallest node of its component.

    ``links`` has two columns of long ids; the order of the two, repeated links and links of a node to itself
    do not matter.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    state = None
    while True:
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == state:
            return edges
        state = (row["n"], row["h"])
        edges = settle(_step(edges), "stars")
