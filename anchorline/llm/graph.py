"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.session import stable


def are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one node at most, and nothing hangs under a node that hangs itself."""
    ends = edges.select("u", F.lit(1).alias("hangs")).unionAll(edges.select(F.col("v").alias("u"), F.lit(0)))
    nodes = ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("n"))
    return nodes.where("hangs > 0 and n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), whole numbers; `root` is the smallest node reachable.

    Each round hangs every node's larger neighbours under its smallest neighbour, then the smaller ones, until
    the links are stars. Neighbours are reduced to their minimum before a shuffle, no list of them is built, and
    the number of rounds grows with the logarithm of a component's length. Null ends and links of a node with itself
    are ignored; repeated links do not matter; no links give no rows.
    """
    edges = stable(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not are_stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stable(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            small.select("u", F.col("m").alias("v"))
        )
        edges = stable(hung.where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select("v", "v").distinct().toDF("node", "root")
    )
