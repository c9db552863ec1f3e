"""Connected components of a link table, by alternating large and small stars.

Every step is a combinable minimum per node and a join, so a node with very many links is split like any skewed join key.
The lineage is cut after each round; no links reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (long columns a, b); root is the smallest node of its component. Self-links count as nodes without partners and are left out."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not found[0] or found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = found
        # large star: larger neighbours move to the smallest of a node's neighbourhood
        least = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct())
