"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, jumps: int = 3) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Each round points every node at its smallest neighbour, shortens these
    pointers, and contracts the graph along them; the edges that are left
    between contracted nodes are the next round's graph. A star or a clique is
    gone after one round, a chain after a few. All state stays in stored tables
    of slim rows, so lost executors do not start it over. Nulls on either end
    are dropped; repeated edges and loops change nothing; no edges give no rows.
    """
    graph = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    graph = scratch.store(graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = None
    while True:
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = scratch.store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("node"), "p"))
        parent = first
        for _ in range(jumps):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("node", F.col("pp").alias("p"))
        parent = scratch.store(parent)
        if names is None:
            renamed = parent.select("node", F.col("p").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "p")
            renamed = names.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        renamed = scratch.store(renamed)
        left = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        rest = graph.join(left, "a").join(right, "b").where("pa <> pb")
        rest = scratch.store(rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        scratch.drop(graph, first, parent, *([names] if names is not None else []))
        graph, names = rest, renamed
        if graph.isEmpty():
            return names
