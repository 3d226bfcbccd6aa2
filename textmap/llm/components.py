"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.session import stage

MAX_ROUNDS = 60


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Alternates the two star operations of Kiveris et al. (2014): every node hangs its larger, then its
    smaller neighbours under the smallest one it knows, until only stars are left. A node with many
    neighbours is met with grouped minima, never as one list. Loops and repeated links are allowed.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = stage(edges, f"{name}-links")
    known = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == known or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        known = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = stage(small, f"{name}-stars")
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
