"""Connected components of an edge table by alternating large-star and small-star steps.

Each step groups by node and joins the smallest neighbour back, so a node with many neighbours costs partial
aggregates and a join that adaptive execution may split (the staged side is a plain exchange), never a collected
group. Steps are staged in the shared folder, and the edges shrink to one row a node within a few of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe.sources.staging import staged



def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(_smallest(both).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("a > b")
    least = staged(_smallest(down), "least")
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that an edge joins to another; the root is the smallest node of its component.

    Nodes are of any type that has an order; null ends and loops are left out. No edges give no rows.
    """
    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = staged(small_star(edges), "star")
    before = print_of(edges)
    while before[0]:
        edges = staged(small_star(large_star(edges)), "star")
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
