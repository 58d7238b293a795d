"""Orders of nodes, random draws, sub-graphs and labels of depressions and oceans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.vectors import noise
from .iterate import levels, reach, to_root
from .neighbours import neighbours
from .parts import least, tile_of


def spiral_key(spec: GridSpec, r: Column, c: Column) -> Column:
    """Where a node comes on a spiral from the upper left corner inwards: ring by ring, clockwise."""
    ring = F.least(r, c, spec.ny - 1 - r, spec.nx - 1 - c)
    w, h = spec.nx - 2 * ring, spec.ny - 2 * ring
    before = F.lit(spec.size) - w * h
    along = (
        F.when(r == ring, c - ring)
        .when(c == spec.nx - 1 - ring, w - 1 + r - ring)
        .when(r == spec.ny - 1 - ring, w - 1 + h - 1 + (spec.nx - 1 - ring - c))
        .otherwise(2 * (w - 1) + h - 1 + (spec.ny - 1 - ring - r))
    )
    return (before + along).cast("long")


def spiral(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return spec.with_rowcol(nodes).select("node", spiral_key(spec, F.col("r"), F.col("c")).alias("at"))


def random_order(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """node and a seeded number to order by."""
    return nodes.select("node", noise(seed, F.col("node")).alias("at"))


def breadth_first(nodes: DataFrame, spec: GridSpec, start: int) -> DataFrame:
    """node, step over the active neighbours of a start."""
    e = neighbours(nodes, spec, values=[]) if "bc" not in nodes.columns else neighbours(nodes, spec, values=["bc"])
    seed = nodes.filter(F.col("node") == start).select("node", F.lit(0.0).alias("value"))
    return least(e, seed, lambda n: tile_of(n, spec)).select("node", F.col("value").cast("int").alias("step"))


def random_node(nodes: DataFrame, seed: int = 0) -> DataFrame:
    return nodes.select("node").orderBy(noise(seed, F.col("node")), "node").limit(1)


def random_neighbour(nodes: DataFrame, spec: GridSpec, seed: int = 0) -> DataFrame:
    """node, nb: one neighbour of each node, drawn evenly by a seeded hash."""
    e = neighbours(nodes.select("node"), spec, values=[])
    return e.groupBy("node").agg(F.min_by("nb", noise(seed, F.struct("node", "nb"))).alias("nb"))


def sfd_order(sfd: DataFrame) -> DataFrame:
    """node, level: steps to the outlet; ordering by it puts every receiver before its donors."""
    return to_root(sfd).select("node", F.col("hops").alias("level"))


def order_is_valid(order: DataFrame, edges: DataFrame) -> bool:
    """Whether every node is in the order once and every edge goes to a lower level."""
    twice = order.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    e = edges.select("node", "nb").join(order.selectExpr("node", "level as l1"), "node", "left").join(order.selectExpr("node as nb", "level as l2"), "nb", "left")
    return twice.isEmpty() and e.filter("l1 is null or l2 is null or l1 <= l2").isEmpty()


def elevation_order(nodes: DataFrame) -> DataFrame:
    """nodes from low to high, ties by node: a total order over the grid by range partitions."""
    return nodes.orderBy("z", "node")


def subgraph(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes downstream of the sources (with them) with their level, and the edges among them."""
    inside = reach(edges, sources).select("node")
    e = edges.join(inside, "node", "left_semi").join(inside.select(F.col("node").alias("nb")), "nb", "left_semi")
    return levels(e, inside), e


def label_ocean(nodes: DataFrame, spec: GridSpec, level: float) -> DataFrame:
    """node, ocean: whether a node at or below a level is connected to the grid's edge by such nodes."""
    low = nodes.filter(F.col("z") <= level).select("node", "z")
    rc = spec.with_rowcol(low)
    seeds = rc.filter(spec.on_edge(F.col("r"), F.col("c"))).select("node", F.lit(0.0).alias("value"))
    wet = least(neighbours(low, spec, values=[]), seeds, lambda n: tile_of(n, spec), 0.0).select("node").withColumn("_o", F.lit(True))
    return nodes.select("node").join(wet, "node", "left").select("node", F.col("_o").isNotNull().alias("ocean"))


def label_depressions(filled: DataFrame, spec: GridSpec) -> DataFrame:
    """node, depression: connected nodes under water of fill() (node, z, filled) share their smallest node; null on land."""
    from .graphs import connected

    wet = filled.filter("filled > z").select("node", F.col("filled").alias("z"))
    e = neighbours(wet, spec, values=["z"]).filter("z = z_nb")
    c = connected(e, wet).select("node", F.col("component").alias("depression"))
    return filled.select("node").join(c, "node", "left")


def random_walk(edges: DataFrame, starts: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """walk, step, node: a seeded walk along edges from each start, ended where there is no edge."""
    at = starts.select(F.col("node").alias("walk"), "node", F.lit(0).alias("step"))
    out = at
    for k in range(1, steps + 1):
        nxt = at.join(edges.select("node", "nb"), "node").groupBy("walk").agg(F.min_by("nb", noise(seed + k, F.struct("walk", "nb"))).alias("node"))
        at = nxt.select("walk", "node", F.lit(k).alias("step"))
        out = out.unionByName(at)
    return out.select("walk", "step", "node")


