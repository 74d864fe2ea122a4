"""Connected components of a graph of links in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component, the least node reachable from it, for each node that some link (u, v) touches; a written table.

    Large-star and small-star rounds: every node is tied to its least neighbour, until each component is a star around
    its least node. A node's least neighbour is an aggregate, so a node with very many links is never gathered.
    Each round is written to the shared folder, which cuts its lineage, and the one before is deleted. No links give an
    empty table; repeated links and links of a node to itself change nothing.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialise(large.where("u <> v").distinct())
        discard(edges)
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(stars)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    discard(edges)
    return out
