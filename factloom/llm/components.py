"""Distributed connected components over an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(node, component)``, the smallest node that links reach.

    Each round hooks every node to its smallest neighbour. Such hooks make trees whose root is a pair of
    nodes that point at each other, as along a cycle every second node would have to be no larger than the
    one before. The smaller of the pair is the root; pointer jumping finds it, and the edges are contracted
    to the roots. A root stands for two nodes at least, so each round leaves at most half of the nodes.
    Only partial aggregates and equi-joins are used: a hub never has its neighbours gathered in one
    task. Nodes that are their own component's minimum are left out; callers coalesce to the node.
    Self-loops, repeated edges and null ends have no effect; an empty table gives an empty table.
    """
    scratch = Scratch(edges.sparkSession, "components")
    left = scratch.store("edges-0", _distinct(edges.select("a", "b")))
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        n = len(rounds)
        hooks = scratch.store(f"hooks-{n}", left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        back = hooks.select(F.col("node").alias("root"), F.col("root").alias("back"))
        single = hooks.join(back, "root").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node")).otherwise(F.col("root")).alias("root"))
        roots = _shorten(scratch, f"{n}", scratch.store(f"roots-{n}-0", single))
        scratch.drop(f"hooks-{n}")
        rounds.append(roots)
        a, b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
        ends = left.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        left = scratch.store(f"edges-{n + 1}", _distinct(ends))
        scratch.drop(f"edges-{n}")
    if not rounds:
        return left.toDF("node", "component")
    named = reduce(_compose, reversed(rounds[:-1]), rounds[-1])
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    return named.join(least, "root").where("node <> component").select("node", "component")


def _distinct(edges: DataFrame) -> DataFrame:
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def _shorten(scratch: Scratch, n: str, hooks: DataFrame) -> DataFrame:
    """Follow hooks to their ends; the distance halves each time."""
    step = 0
    while True:
        onward = hooks.toDF("root", "next")
        jumped = scratch.store(f"roots-{n}-{step + 1}", hooks.join(onward, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        scratch.drop(f"roots-{n}-{step}")
        hooks, step = jumped.select("node", "root"), step + 1
        if jumped.where("moved").isEmpty():
            return hooks


def _compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Roots of an earlier round through a later one; a root without edges left is its own."""
    moved = earlier.join(later.toDF("root", "final"), "root", "left")
    return moved.select("node", F.coalesce("final", "root").alias("root"))
