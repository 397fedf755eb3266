"""Connected components by contraction: whole rounds of joins, written to the shared folder in between."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import kept


def _compress(parent: DataFrame) -> DataFrame:
    """node -> parent of its parent: halves the height of every chain."""
    up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
    return parent.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): component is the smallest node reachable.

    Every node takes the smallest of itself and its neighbours as parent, chains are shortened,
    and edges move to the parents, until none joins two different nodes. Each round shrinks every
    component with edges left to at most half its nodes' local minima, so rounds grow with the logarithm.
    """
    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    whole = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        parent = _compress(kept(parent.select("node", F.least("node", "parent").alias("parent")), "parents"))
        new = (edges.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b").where("pa <> pb")
               .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        edges = kept(new, "edges")
        if whole is None:
            whole = parent.toDF("node", "component")
        else:
            step = parent.toDF("component", "top")
            whole = kept(whole.join(step, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
    return whole if whole is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
