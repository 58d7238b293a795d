"""Iteration over flow graphs: pointer doubling for single flow, level loops for multiple flow, closures.

Every round ends in a table of its own in the shared folder (scratch.cut), so lineage stays short and a lost
executor doesn't repeat earlier rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, exists, scratch_path
from . import blocks


def upstream_fold(sfd: DataFrame, values: DataFrame, combine: Callable[[Column], Column], merge: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """node, value: each node's own value combined with those of all nodes upstream of it.

    ``combine`` aggregates the values that meet at a node, ``merge`` joins the aggregate with the node's value,
    and ``step(value, length)`` carries a value along a path. Sums and extremes of numbers go by blocks of nodes
    (``blocks``), where only ways between blocks go round by round; for these ``step`` must do for arrays as well.
    """
    step = step or (lambda v, d: v)
    how = {F.sum: "sum", F.max: "max", F.min: "min"}.get(combine)
    if how and (blocks.whole(values) or values.schema["value"].dataType.simpleString() in ("double", "float")):
        return blocks.fold(sfd, values, how, step, lambda s, v: _fold_rounds(s, v, combine, merge, step))
    return _fold_rounds(sfd, values, combine, merge, step)


def _fold_rounds(sfd: DataFrame, values: DataFrame, combine: Callable, merge: Callable, step: Callable) -> DataFrame:
    """After round k a node has met everything less than 2^k steps upstream; pointers past a root are dropped, so the active
    rows shrink."""
    value = cut(values.select("node", "value"))
    jump = cut(sfd.filter("node <> rec").select("node", F.col("rec").alias("to"), F.col("dx").alias("d")))
    while not jump.isEmpty():
        sent = jump.join(value, "node").groupBy(F.col("to").alias("node")).agg(combine(step(F.col("value"), F.col("d"))).alias("got"))
        value = cut(value.join(sent, "node", "left").select("node", merge(F.col("value"), F.col("got")).alias("value")))
        nxt = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        jump = cut(jump.join(nxt, "to").select("node", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d")))
    return value


def to_root(sfd: DataFrame, weight: Column | None = None) -> DataFrame:
    """node, root, hops, length: the end of each node's path and how far it is (lengths of ``weight``, dx by default). Within
    blocks of nodes ways are followed in a task, and only what enters a block goes round by round (``blocks``)."""
    return blocks.ends(sfd, F.col("dx") if weight is None else weight, _root_rounds)


def _root_rounds(at: DataFrame) -> DataFrame:
    at = cut(at)
    while True:
        ahead = at.filter("hops > 0").select(F.col("node").alias("root"), F.col("root").alias("root2"), F.col("hops").alias("hops2"), F.col("length").alias("length2"))
        if at.join(ahead, "root", "left_semi").isEmpty():
            return at
        far = at.join(ahead, "root", "left")
        at = cut(
            far.select(
                "node",
                F.coalesce("root2", "root").alias("root"),
                (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"),
                (F.col("length") + F.coalesce("length2", F.lit(0.0))).alias("length"),
            )
        )


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: length of the longest path to a node without receivers. Raises if the edges have a cycle.

    Nodes are finished from the outlets up (Kahn): a round finishes those whose receivers all are, by counts of
    open receivers, so each edge is sent once in all.
    """
    e = cut(edges.select("node", "nb"))
    degree = e.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    state = nodes.select("node").join(degree, "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"))
    state, level = cut(state), 0
    front = cut(state.filter("k = 0").select("node"))
    done = front.withColumn("level", F.lit(0))
    open_ = state.filter("k > 0")
    while not front.isEmpty():
        level += 1
        if level > 2 and level & (level - 1) == 0:  # edges to finished nodes are left behind
            e = cut(e.join(open_.unionAll(front.withColumn("k", F.lit(0))).select(F.col("node").alias("nb")), "nb", "left_semi").select("node", "nb"))
        freed = e.join(front.select(F.col("node").alias("nb")), "nb", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("f"))
        after = cut(open_.join(freed, "node", "left").select("node", (F.col("k") - F.coalesce("f", F.lit(0))).alias("k")))
        front, open_ = after.filter("k = 0").select("node"), after.filter("k > 0")
        done = done.unionAll(front.withColumn("level", F.lit(level)))
        if level % 16 == 0:
            done = cut(done)
    if not open_.isEmpty():
        raise ValueError("the edges have a cycle")
    return cut(done.select("node", F.col("level").cast("long").alias("level")))


def _by_level(df: DataFrame, level: str, path: str) -> DataFrame:
    """A table with a folder for each level. Rows of a level are dealt out by size, so a large level is several files."""
    df.hint("rebalance", level).write.partitionBy(level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def level_loop(edges: DataFrame, start: DataFrame, level: DataFrame, send: Column, combine: Callable[[Column], Column], merge: Callable[[Column, Column], Column], downstream: bool = True) -> DataFrame:
    """node, value: values sent along weighted edges in order of level.

    Downstream: from the highest level down, each node's final value is sent to its receivers. Upstream: from
    level 0 up, to its donors. ``send`` is over value and the edge's columns; what meets at a node is combined
    and merged with its value. One round for each level that has edges: it reads this level's edges and values and
    what was sent to it, and writes what it sends by the level that takes it, so every edge, value and message is
    read once in all rounds. All that was sent makes the values in one pass at the end.
    """
    spark = edges.sparkSession
    root = scratch_path(spark)
    e = edges.join(level, "node").withColumnRenamed("level", "l_from").join(level.selectExpr("node as nb", "level as l_to"), "nb")
    source, target, order, goal = ("node", "nb", "l_from", "l_to") if downstream else ("nb", "node", "l_to", "l_from")
    e = _by_level(e, order, f"{root}/edges")
    rounds = [r[0] for r in e.select(order).distinct().collect()]
    value = _by_level(start.select("node", "value").join(level, "node", "left").withColumnRenamed("level", "l"), "l", f"{root}/values")
    for k in sorted(rounds, reverse=downstream):
        mine = value.filter(F.col("l") == k).select("node", "value")
        met = f"{root}/sent/from=*/{goal}={k}"
        if exists(spark, met):
            got = spark.read.schema(sent.drop(goal).schema).parquet(met).groupBy("node").agg(combine("got").alias("got"))
            mine = mine.join(got, "node", "left").select("node", F.when(F.col("got").isNull(), F.col("value")).otherwise(merge(F.col("value"), F.col("got"))).alias("value"))
        part = e.filter(F.col(order) == k).drop(order)
        sent = part.join(mine.withColumnRenamed("node", source), source).groupBy(F.col(target).alias("node"), goal).agg(combine(send).alias("got"))
        sent.hint("rebalance", goal).write.partitionBy(goal).parquet(f"{root}/sent/from={k}")
    if not rounds:
        return value.select("node", "value")
    every = spark.read.schema(sent.drop(goal).schema).option("recursiveFileLookup", True).parquet(f"{root}/sent")
    got = every.groupBy("node").agg(combine("got").alias("got"))
    return cut(value.join(got, "node", "left").select("node", F.when(F.col("got").isNull(), F.col("value")).otherwise(merge(F.col("value"), F.col("got"))).alias("value")))


def reach(edges: DataFrame, seeds: DataFrame, source: str = "node", target: str = "nb", limit: int | None = None) -> DataFrame:
    """node, step: the nodes that the seeds reach along edges, and the fewest steps; the seeds are at step 0."""
    e = cut(edges.select(F.col(source).alias("a"), F.col(target).alias("b")))
    seen = front = cut(seeds.select("node", F.lit(0).alias("step")).distinct())
    step = 0
    while limit is None or step < limit:
        step += 1
        new = front.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti").withColumn("step", F.lit(step)))
        if front.isEmpty():
            break
        seen = cut(seen.unionAll(front)) if step % 8 == 0 else seen.unionAll(front)
    return seen


def relax(edges: DataFrame, start: DataFrame, send: Column, rounds: int | None = None) -> DataFrame:
    """node, value: the least value that reaches each node along edges (node to nb), to a fixpoint.

    ``send`` is over value and the edge's columns and must not fall below value. Only nodes that improved send.
    """
    e = cut(edges)
    value = cut(start.select("node", "value"))
    front, k = value, 0
    while rounds is None or k < rounds:
        k += 1
        got = front.join(e, "node").groupBy(F.col("nb").alias("node")).agg(F.min(send).alias("got"))
        both = cut(value.join(got, "node", "full"))
        better = F.col("got").isNotNull() & (F.col("value").isNull() | (F.col("got") < F.col("value")))
        front = cut(both.filter(better).select("node", F.col("got").alias("value")))
        value = both.select("node", F.least("value", "got").alias("value"))
        if front.isEmpty():
            break
    return cut(value)
