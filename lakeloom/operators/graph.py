"""Connected components and reachability by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; a component is named by its smallest node.

    Alternates large-star and small-star steps, each a grouping and a join without a group that must be held in memory, until
    every node but the components' smallest has one edge, to that smallest; each step is written out, so lineage
    stays short. Loops and null ends are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e):
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), "large")
        # small star: the smaller neighbours and the node itself go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = materialize(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "small")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _stars(e: DataFrame) -> bool:
    """Whether every node on the larger end of an edge has one edge and is no smaller end."""
    if not e.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
