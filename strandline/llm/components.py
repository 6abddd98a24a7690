"""Connected components by contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def _map(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace ``column`` by its parent where it has one."""
    p = parents.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return df.join(p, df[column] == F.col("_a"), "left").withColumn(column, F.coalesce("_b", column)).drop("_a", "_b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long); the component is its smallest node.

    Each round hangs every node on its smallest neighbour if that is smaller, jumps pointers to the
    roots and contracts the edges, until none is left. Tables are written between joins, so both
    sides of every join have exchanges of their own and a hub's rows can be split; nothing but row
    counts reaches the driver. Repeated edges and loops do not matter.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    labels = staged(nodes.withColumn("component", F.col("node")), "cc-nodes")
    left = staged(edges.filter("u <> v").select("u", "v").distinct(), "cc-edges")
    while not left.isEmpty():
        both = left.union(left.select(F.col("v"), F.col("u")).toDF("u", "v")).filter("v < u")
        parents = staged(both.groupBy(F.col("u").alias("a")).agg(F.min("v").alias("b")), "cc-parents")
        while True:
            jumped = staged(_map(parents.withColumn("old", F.col("b")), "b", parents), "cc-jump")
            moved = not jumped.filter("b <> old").isEmpty()
            release(parents)
            parents = jumped.drop("old")
            parents._stage_path = jumped._stage_path
            if not moved:
                break
        new_labels = staged(_map(labels, "component", parents), "cc-labels")
        new_left = staged(_map(_map(left, "u", parents), "v", parents).filter("u <> v").distinct(), "cc-left")
        release(labels, left, parents)
        labels, left = new_labels, new_left
    return labels
