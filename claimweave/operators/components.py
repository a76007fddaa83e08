"""Connected components of a graph that is an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.session import cut_lineage

#: Jumps between two written tables.
JUMPS = 3


def _jump(hooks: DataFrame) -> DataFrame:
    """Each label's target replaced by the target of that target; ``moved`` if there was one."""
    further = hooks.select(F.col("label").alias("to"), F.col("to").alias("_next"))
    jumped = hooks.join(further, "to", "left")
    return jumped.select("label", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable from each end of an edge; ``edges(a, b)`` of any
    sortable type, structs included. Nodes without an edge to another have no row.

    Every round hooks each label to its smallest neighbour, follows the hooks to their ends by
    doubling, and goes on with the edges between what is left. A chain in ascending
    order is one round; rounds and jumps follow logarithms. Every round is a written table,
    and no group of neighbours is ever gathered.
    """
    left = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        hooks = left.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("to"))
        while True:
            for _ in range(JUMPS):
                hooks = _jump(hooks.select("label", "to"))
            hooks = cut_lineage(hooks)
            if hooks.filter("moved").isEmpty():
                break
        to = hooks.select(F.col("label").alias("component"), "to")
        nodes = cut_lineage(nodes.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        ends = left
        for side in ("a", "b"):
            renamed = hooks.select(F.col("label").alias(side), F.col("to").alias(f"_{side}"))
            ends = ends.join(renamed, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
        left = cut_lineage(ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return nodes
