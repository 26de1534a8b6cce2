"""Connected components by edge contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has an edge to another one.

    Each round hooks a node to its smallest neighbour, follows those hooks to their ends by pointer
    doubling, and replaces the edges by those between the ends that are left, so rounds work on ever fewer
    rows and their number grows with the logarithm of the longest chain. Nothing is collected; each round
    is written to the shared folder and deleted when the next one is. Null ends, loops and repeated edges are ignored.
    """
    return with_roots(led_to_roots(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), Scratch(edges.sparkSession)))


def with_roots(labels: DataFrame) -> DataFrame:
    """``led_to_roots`` and a row for each root."""
    roots = labels.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return labels.unionByName(roots)


def relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """Where ``labels`` lead after their components have been merged by ``further``; neither holds its roots."""
    moved = further.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component")).unionByName(further.select("node", "component"))


def led_to_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` of every node but each component's smallest, as a written table."""
    x, y = F.col("a"), F.col("b")
    left = scratch.written(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        hooks = _ends(scratch.written(left.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node"), "hooks"), scratch)
        ha = hooks.select(F.col("node").alias("a"), F.col("component").alias("_a"))
        hb = hooks.select(F.col("node").alias("b"), F.col("component").alias("_b"))
        ends = left.join(hb, "b").join(ha, "a", "left").select(F.col("_b").alias("b"), F.coalesce("_a", "a").alias("a"))  # every b has a hook
        fewer = scratch.written(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        longer = hooks if labels is None else scratch.written(relabelled(labels, hooks), "labels")
        scratch.drop(left, *([] if labels is None else [labels, hooks]))
        left, labels = fewer, longer
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    scratch.drop(left)
    return labels.select("node", "component")


def _ends(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """Where the hooks (node, component) lead in the end."""
    while True:
        further = hooks.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        longer = hooks.join(further, "component", "left").select("node", F.coalesce("_to", "component").alias("component"), F.col("_to").isNotNull().alias("moved"))
        longer = scratch.written(longer, "hooks")
        scratch.drop(hooks)
        hooks = longer
        if hooks.filter("moved").isEmpty():
            return hooks
