"""Room graphs as tables: reachability, components, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.rounds import settled


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., node, component): the smallest node that each node reaches within its key.

    Labels move along edges and then jump to the label of their label, so a chain of n nodes
    takes about log n rounds.
    """
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = settled(edges.select(*keys, F.inline(F.array(way("a", "b"), way("b", "a")))).distinct())
    labels = settled(nodes.select(*keys, "node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(*keys, F.col("node").alias("b"), F.col("component").alias("other")), [*keys, "b"])
        best = near.groupBy(*keys, F.col("a").alias("node")).agg(F.min("other").alias("other"))
        moved = labels.join(best, [*keys, "node"], "left").select(*keys, "node", "component", F.least("component", F.coalesce("other", "component")).alias("new"))
        jump = moved.select(*keys, F.col("node").alias("new"), F.col("new").alias("further"))
        fresh = moved.join(jump, [*keys, "new"], "left").select(*keys, "node", "component", F.least("new", F.coalesce("further", "new")).alias("new"))
        fresh = settled(fresh)
        changed = fresh.where("component <> new").limit(1).count()
        labels = fresh.select(*keys, "node", F.col("new").alias("component"))
        if not changed:
            return labels


def connected(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(key..., connected): whether all nodes of a key reach each other."""
    found = components(nodes, edges, keys)
    return found.groupBy(*keys).agg((F.count_distinct("component") <= 1).alias("connected"))


def neighbours(edges: DataFrame, keys: list[str], walkable_only: bool = True) -> DataFrame:
    """(key..., room, neighbour), one row for each edge and direction; walls are not walkable."""
    inner = edges.where("not exterior")
    inner = inner.where("kind <> 'wall'") if walkable_only else inner
    # both directions of a row, not of the table, which would be computed twice
    way = lambda a, b: F.struct(F.col(a).alias("room"), F.col(b).alias("neighbour"))
    return inner.select(*keys, F.inline(F.array(way("a", "b"), way("b", "a"))))


def entrances(edges: DataFrame) -> DataFrame:
    return edges.where("exterior and kind in ('door', 'opening')")
