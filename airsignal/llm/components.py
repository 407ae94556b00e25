"""Connected components of a link table by alternating star contractions, with the state on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import saved


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that occurs in ``links``; component is the smallest node reachable.

    Each round attaches the larger neighbours of every node to its smallest neighbour (large star) and
    then the smaller ones (small star); the table of each round is written to shared storage and only
    one number per round, its checksum, reaches the driver. The minima are written too, so that both sides
    of a join are plain exchanges and Spark can split the rows of a node with very many neighbours. Self links, repeated links and empty tables are fine.
    """
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    edges = saved(edges, "cc")
    before = None
    while True:
        # large star: larger neighbours of u, and u itself, point to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.distinct(), "cc")
        # small star: smaller neighbours of u, and u itself, point to the smallest of them
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = saved(small, "cc")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
