"""Depth-first order of flow forests: what drains to a node is a range of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .accumulate import flow_count
from .iterate import to_root

BLOCK = 65536


def depth_first(sfd: DataFrame) -> DataFrame:
    """node, root, at, size, depth, post: where a node comes in depth-first order from the outlets, receivers first.

    Trees follow each other by root and donors by node, both ascending. The nodes that drain to a node, itself
    included, are those with ``at`` in [at, at + size). ``post`` is the place where donors come first; an Euler tour
    enters a node at 2 * at - depth and leaves it at 2 * at - depth + 2 * size - 1.

    Sizes go up and offsets come down by pointer doubling: a node's place is the sum, along its path, of one and the
    sizes of the donors before it. The donors of a node meet in a task (eight at most on a grid); the roots' sizes are
    summed by blocks of roots, of which only the totals meet.
    """
    sized = cut(sfd.select("node", "rec").join(flow_count(sfd).select("node", (F.col("value") + 1).alias("size")), "node"))
    before = Window.partitionBy("rec").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    donors = sized.filter("node <> rec").select("node", "rec", (1 + F.coalesce(F.sum("size").over(before), F.lit(0))).cast("double").alias("dx"))
    roots = sized.filter("node = rec").select("node", "rec", "size", F.floor(F.col("node") / BLOCK).alias("block"))
    first = roots.groupBy("block").agg(F.sum("size").alias("k")).selectExpr("block", "sum(k) over (order by block) - k as first")
    base = roots.join(first, "block").selectExpr("node as root", "cast(first + sum(size) over (partition by block order by node) - size as long) as base")
    placed = to_root(donors.unionAll(roots.select("node", "rec", F.lit(0.0).alias("dx")))).join(sized.select("node", "size"), "node").join(base, "root")
    at = F.col("base") + F.col("length").cast("long")
    depth = F.col("hops").cast("long")
    return cut(placed.select("node", "root", at.alias("at"), F.col("size").cast("long").alias("size"), depth.alias("depth"), (at + F.col("size") - 1 - depth).cast("long").alias("post")))


def upstream_in(order: DataFrame, starts: DataFrame, include_self: bool = False) -> DataFrame:
    """node of all nodes that drain to any of the starts (node), by the ranges of ``depth_first``: no walk along edges.

    Ranges of starts may lie within each other. A node is in one if and only if the farthest end of the starts before it
    lies behind it; that end is carried from block to block of the order by the table of blocks, and within a block by a
    window, so neither many starts nor a long range gather in a task. Starts outside the order count for nothing, and
    repeated ones once. A start is returned only with ``include_self`` or if it drains to another.
    """
    marked = order.join(starts.select("node").distinct().withColumn("_start", F.lit(True)), "node", "left")
    end = F.when(F.col("_start"), F.col("at") + F.col("size"))
    marked = marked.select("node", "at", end.alias("end"), F.floor(F.col("at") / BLOCK).alias("block"))
    ends = marked.groupBy("block").agg(F.max("end").alias("end"))
    carried = ends.select("block", F.max("end").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    last = 0 if include_self else -1
    within = F.max("end").over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, last))
    return marked.withColumn("within", within).join(carried, "block").filter(F.greatest("within", "carry") > F.col("at")).select("node")
