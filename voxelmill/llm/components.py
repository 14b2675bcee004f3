"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two shuffles over the edges; nothing is gathered in the driver but a convergence sum.  The neighbours of a node that
has over 1 / HOT of all edges, as the root of a giant component does, stay where they are and meet its least neighbour by
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.shared import hot_keys, spread_join, stash


def _star(edges: DataFrame, large: bool, total: int = 0) -> DataFrame:
    """Links each neighbour of a node to the least node around it: the larger neighbours, or the
    smaller ones and the node itself.  Only the first has nodes of many neighbours: after it, each has few smaller ones."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        around = both.unionByName(back)
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        hubs = hot_keys(least.select("u", "rows"), 2 * total, "hubs")
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = spread_join(around.filter("v > u"), least, "u", hubs).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        around = both.unionByName(back).filter("v < u")
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        moved = around.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the least node reachable.

    Loops, repeated edges and either direction are fine; an empty table gives no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state, total = None, edges.count()
    while True:
        edges = stash(_star(_star(edges, True, total), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        total = now[0]
        if now == state:
            break
        state = now
    root = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(root)
