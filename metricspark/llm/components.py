"""Connected components over an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch, stored


def follow_parents(parents: DataFrame) -> DataFrame:
    """Roots of a forest given as (node, parent), a root being its own parent.

    Every round doubles the distance that a pointer spans.
    """
    with scratch() as scope:
        return scope.keep(_follow(scope, parents))


def _follow(scope, parents: DataFrame) -> DataFrame:
    last = current = stored(parents)
    while True:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        after = stored(current.join(up, "parent").select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")))
        if after.filter("moved").isEmpty():
            return stored(after.select("node", F.col("parent").alias("root")))
        scope.drop(last)
        last, current = after, after.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b); component is the smallest node.

    Each round takes over the smallest label among the neighbours and then the label of the
    label. Minima combine before the shuffle, so a hub costs no more than its edges.
    """
    with scratch() as scope:
        return scope.keep(_connected(scope, edges))


def _connected(scope, edges: DataFrame) -> DataFrame:
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    last = labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("component")))
    while True:
        heard = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        after = stored(lower.join(of_label, "label", "left").select(
            "node", F.least("label", "next").alias("component"), (F.least("label", "next") != F.col("was")).alias("moved")))
        scope.drop(last)
        last, labels = after, after.select("node", "component")
        if after.filter("moved").isEmpty():
            return stored(labels)
