"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.session import materialize


def _compressed(parents: DataFrame) -> DataFrame:
    """parents(node, parent) with every node under its root, by pointer jumping."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        jumped = parents.join(above, "parent", "left").select(
            "node", F.coalesce("top", "parent").alias("parent"), (F.coalesce("top", "parent") != F.col("parent")).alias("moved")
        )
        jumped = materialize(jumped, "jump")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): the smallest node it is connected with.

    Each round, a node with a smaller neighbour hooks under its smallest one, trees
    are flattened, and only edges between different trees go on. At least every
    node that isn't a local minimum disappears, so rounds grow with the logarithm.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    edges = materialize(edges.where("a <> b").select(both).select("e.*").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents = _compressed(hooks.select("node", F.least("node", "low").alias("parent")))
        under_a, under_b = (parents.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "ab")
        edges = edges.join(under_a, "a").join(under_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = materialize(edges.distinct(), "edges")
        roots = parents.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = materialize(labels, "labels")
    return labels
