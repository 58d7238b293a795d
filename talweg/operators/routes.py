"""Shortest ways between two nodes: bounds from below leave out what no shortest way passes, tiles are solved as a whole.

Weights are above 0 and the same both ways, and edges are there both ways. A round solves the tiles that got something
better and hands values on at their rims, so rounds grow with the tiles that a way crosses and not with its steps. Values
of landmarks, found once for many searches, bound a way's length from above and what is left of it from below (Goldberg
and Harrelson, 2005): nodes that cannot be on a shortest way are left out before the search begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..scratch import cut
from . import voxelways
from .parts import SLACK, TILE, spread, tile_of
from .voxels import XYZ

def _weighted(edges: DataFrame, spec: GridSpec, weight: str, side: int) -> DataFrame:
    return edges.select("node", "nb", F.col(weight).cast("double").alias("w"), tile_of(F.col("node"), spec, side).alias("part"), tile_of(F.col("nb"), spec, side).alias("part_nb"))


def extreme_nodes(edges: DataFrame, spec: GridSpec) -> list[int]:
    """Up to four nodes with edges, the farthest in the directions of the corners: landmarks that bound most ways well."""
    r, c = spec.row(F.col("node")), spec.col(F.col("node"))
    ways = [r + c, r - c, c - r, -r - c]
    row = edges.agg(*[F.max_by("node", F.struct(w, -F.col("node"))) for w in ways]).first()
    return sorted({n for n in row if n is not None})


def landmark_distances(edges: DataFrame, spec: GridSpec, marks: list[int], weight: str = "dx", side: int = TILE) -> DataFrame:
    """node, d: the distances to the landmarks in their order, null where there is no way. For any number of searches."""
    starts = edges.sparkSession.createDataFrame([(k, n, 0.0) for k, n in enumerate(marks)], "mark long, node long, value double")
    starts = starts.withColumn("part", tile_of(F.col("node"), spec, side))
    found, _ = spread(_weighted(edges, spec, weight, side).withColumn("low_nb", F.lit(0.0)), starts)
    d = F.array(*[F.max(F.when(F.col("mark") == k, F.col("value"))) for k in range(len(marks))])
    return cut(found.groupBy("node").agg(d.alias("d")))


def _low(d: str, at: list[float | None]) -> Column:
    """A bound from below on the way from a node to one with the distances ``at``; infinite where there is no way."""
    parts = [F.lit(0.0)]
    for k, v in enumerate(at):
        mine = F.col(d)[k]
        parts.append(F.when(mine.isNull(), F.lit(0.0 if v is None else float("inf"))).otherwise(F.lit(float("inf")) if v is None else F.abs(mine - F.lit(v))))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def ancestors(parent: DataFrame, node: int) -> DataFrame:
    """step, node: a node (step 0) and all that its pointers (node, to) lead to; pointers are doubled in each round."""
    seen = parent.sparkSession.createDataFrame([(0, node)], "step long, node long")
    jump, length = cut(parent.select("node", "to")), 1
    while True:
        more = seen.join(jump, "node").select((F.col("step") + length).alias("step"), F.col("to").alias("node"))
        seen = cut(seen.unionAll(more))
        if seen.filter(F.col("step") >= length).isEmpty():
            return seen
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("to2")).hint("merge")
        jump, length = cut(jump.join(ahead, "to").select("node", F.col("to2").alias("to"))), 2 * length


def _traced(edges: DataFrame, values: DataFrame, start: int, goal: int) -> DataFrame:
    """step (from the start), node, value of the way to the goal. Of several nodes a least value may come from, the way
    takes the one of least value, then of least number."""
    d1, d2 = values.selectExpr("node", "value as d1").hint("merge"), values.selectExpr("node as nb", "value as d2").hint("merge")
    near = F.abs(F.col("d1") + F.col("w") - F.col("d2")) <= SLACK * (1 + F.abs("d2"))
    tight = edges.select("node", "nb", "w").join(d1, "node").join(d2, "nb").filter(near & (F.col("d1") < F.col("d2")) & (F.col("nb") != start))
    back = tight.groupBy(F.col("nb").alias("node")).agg(F.min_by("node", F.struct("d1", "node")).alias("to"))
    if values.filter(F.col("node") == goal).isEmpty():
        return values.select(F.lit(0).cast("long").alias("step"), "node", "value").limit(0)
    way = cut(ancestors(back, goal).join(values, "node"))
    last = way.agg(F.max("step")).first()[0]
    return way.select((F.lit(last) - F.col("step")).alias("step"), "node", "value")


def shortest_route(edges: DataFrame, spec: GridSpec, landmarks: DataFrame, start: int, goal: int, weight: str = "dx", side: int = TILE) -> tuple[DataFrame, DataFrame, int]:
    """The shortest way between two nodes of a grid (step, node, value), the nodes searched for it (node, value), and the
    rounds that took. Without a way both tables are empty. ``landmarks`` is of landmark_distances() with the same weight."""
    spark = edges.sparkSession
    at = {r["node"]: r["d"] for r in landmarks.filter(F.col("node").isin(start, goal)).collect()}
    if start == goal:
        way = spark.createDataFrame([(0, start, 0.0)], "step long, node long, value double")
        return way, way.select("node", "value"), 0
    none = [None] * max((len(d) for d in at.values()), default=0)
    a, b = at.get(start, none), at.get(goal, none)
    upper = min((x + y for x, y in zip(a, b) if x is not None and y is not None), default=float("inf"))
    e = _weighted(edges, spec, weight, side)
    if any(v is not None for v in a + b):  # else no landmark knows them, and every node stays in question
        left = landmarks.select("node", _low("d", a).alias("low_a"), _low("d", b).alias("low"))
        left = left.filter(F.col("low_a") + F.col("low") <= min(upper * (1 + SLACK), 1.7e308)).select("node", "low")
        e = e.join(left.select("node"), "node", "left_semi").join(left.selectExpr("node as nb", "low as low_nb"), "nb")
    e = cut(e if "low_nb" in e.columns else e.withColumn("low_nb", F.lit(0.0)))
    first = spark.createDataFrame([(0, start, 0.0)], "mark long, node long, value double").withColumn("part", tile_of(F.col("node"), spec, side))
    found, rounds = spread(e, first, goal, upper)
    values = found.select("node", "value")
    if values.filter(F.col("node") == goal).isEmpty():
        values = values.limit(0)
    return _traced(e, values, start, goal), values, rounds


def voxel_route(vox: DataFrame, start: tuple[int, int, int], goal: tuple[int, int, int], connectivity: int = 6, where: Column | None = None, side: int | None = None) -> DataFrame:
    """step, x, y, z, value of the shortest way between two voxels through existing ones (that meet a condition); a step
    is as long as it is straight. Ties go to the least value, then to the first place. Empty without a way."""
    return separate_routes(vox, start, goal, 1, 0, connectivity, where, side=side).drop("route")


def separate_routes(vox: DataFrame, start: tuple[int, int, int], goal: tuple[int, int, int], most: int = 3, separation: int = 2, connectivity: int = 6, where: Column | None = None, open_ends: bool = True, side: int | None = None) -> DataFrame:
    """route, step, x, y, z, value: up to ``most`` ways, each the shortest that keeps out of the cubes of ``separation``
    around all cells of those before it. Ends at the first that has no way.

    What is within ``separation`` of start or goal stays open, else all ways but the first would be shut in at once;
    with ``open_ends`` false only start and goal themselves do. Voxels are packed into blocks once for all ways.
    """
    names = ["route", "step", *XYZ, "value"]
    spark, start, goal = vox.sparkSession, tuple(start), tuple(goal)
    out = spark.createDataFrame([], "route long, step long, x long, y long, z long, value double")
    found = voxelways.found_in(vox if where is None else vox.filter(where), start, goal, connectivity, side)
    if found is None:
        return out
    blocks, geo = found
    free = separation if open_ends else 0
    for k in range(1, most + 1):
        if start == goal:
            way = spark.createDataFrame([(0, *start, 0.0)], "step long, x long, y long, z long, value double")
        else:
            way = cut(voxelways.way(blocks, geo, start, goal))
        out = out.unionAll(way.withColumn("route", F.lit(k).cast("long")).select(*names))
        if k == most or way.isEmpty():
            return out
        near = way.select(*XYZ)
        for c in XYZ:
            near = near.withColumn(c, F.explode(F.sequence(F.col(c) - separation, F.col(c) + separation)))
        for p in (start, goal):
            near = near.filter(F.greatest(*[F.abs(F.col(c) - v) for c, v in zip(XYZ, p)]) > free)
        inside = [F.col(c).between(lo, lo + n - 1) for c, lo, n in zip(XYZ, geo.low, geo.size)]
        blocks = voxelways.without(blocks, near.filter(inside[0] & inside[1] & inside[2]).distinct(), geo)
    return out
