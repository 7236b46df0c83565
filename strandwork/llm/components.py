"""Connected components by alternating large and small stars (Spark joins and partial aggregates only)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) for every node of `links` (a, b); the component is its smallest node.

    A hub costs one row per link and round: its least neighbour comes from a partial aggregate, and the join back is one that
    Spark can split. Links with a null end or equal ends are ignored.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    mark = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a > b").distinct()
        edges = stored(small, name)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.toDF("node", "component").union(edges.select("b", "b").distinct())
        mark = now
