"""Accumulation, distances, basins, closures and masks over flow graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import GridSpec, distance
from .iterate import level_loop, levels, reach, to_root, upstream_fold
from .neighbours import neighbours
from .tiles import propagate


def _plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def accumulate_sfd(sfd: DataFrame, values: DataFrame | None = None, constant: float = 1.0, scale: float = 1.0) -> DataFrame:
    """node, value: a node's own value and those of all nodes upstream by single flow, times ``scale``."""
    v = sfd.select("node", F.lit(constant).alias("value")) if values is None else values.join(sfd.select("node"), "node").select("node", "value")
    out = upstream_fold(sfd, v, F.sum, _plus)
    return out if scale == 1.0 else out.withColumn("value", F.col("value") * scale)


def drainage_area_sfd(sfd: DataFrame, spec: GridSpec) -> DataFrame:
    return accumulate_sfd(sfd, constant=spec.cell_area)


def flow_count(sfd: DataFrame) -> DataFrame:
    """node, value: nodes upstream, the node itself not counted."""
    return accumulate_sfd(sfd, sfd.select("node", F.lit(1).cast("long").alias("value"))).withColumn("value", F.col("value") - 1)


def accumulate_mfd(edges: DataFrame, nodes: DataFrame, values: DataFrame | None = None, constant: float = 1.0, scale: float = 1.0, weight: str = "weight", level: DataFrame | None = None, spec: GridSpec | None = None) -> DataFrame:
    """node, value: a node's own value and the shares that its donors pass on (edges with weights). With the grid it goes
    by tiles, else level by level."""
    start = nodes.select("node", F.lit(float(constant)).alias("value")) if values is None else values
    if spec is not None:
        out = propagate(edges, start, spec, "sum", F.col(weight))
    else:
        out = level_loop(edges, start, levels(edges, nodes) if level is None else level, F.col("value") * F.col(weight), F.sum, _plus)
    return out if scale == 1.0 else out.withColumn("value", F.col("value") * scale)


def accumulate_with(edges: DataFrame, start: DataFrame, level: DataFrame, send: Column, combine: Callable[[Column], Column] = F.sum, include_self: bool = True) -> DataFrame:
    """Generic accumulation downstream: ``send`` is a column over value and the edge's columns (weight, slope, dx,
    ...), ``combine`` an aggregate. Without ``include_self`` a node's own value is only sent on."""
    merge = {F.sum: _plus, F.max: lambda a, b: F.greatest(a, b), F.min: lambda a, b: F.least(a, b)}[combine]
    out = level_loop(edges, start, level, send, combine, merge)
    if include_self:
        return out
    return out.join(start.withColumnRenamed("value", "own"), "node").select("node", (F.col("value") - F.col("own")).alias("value"))


def with_loss(edges: DataFrame, start: DataFrame, level: DataFrame | None, loss: float, spec: GridSpec | None = None) -> DataFrame:
    """A share ``loss`` is lost on each edge. With the grid it goes by tiles and needs no levels."""
    if spec is not None:
        return propagate(edges, start, spec, "sum", F.col("weight") * (1 - loss))
    return accumulate_with(edges, start, level, F.col("value") * F.col("weight") * (1 - loss))


def discharge(edges: DataFrame, rain: DataFrame, level: DataFrame | None, spec: GridSpec) -> DataFrame:
    """node, value: rain (rate by node) on each cell and everything that flows in; by level if levels are given, else by tiles."""
    start = rain.select("node", (F.col("value") * spec.cell_area).alias("value"))
    if level is None:
        return propagate(edges, start, spec, "sum", F.col("weight"))
    return accumulate_with(edges, start, level, F.col("value") * F.col("weight"))


def extreme_upstream(sfd: DataFrame, values: DataFrame, highest: bool = True) -> DataFrame:
    """node, value: the largest or least value among a node and all nodes upstream of it."""
    if highest:
        return upstream_fold(sfd, values, F.max, lambda a, b: F.greatest(a, b))
    return upstream_fold(sfd, values, F.min, lambda a, b: F.least(a, b))


def sum_at_outlets(sfd: DataFrame, values: DataFrame, nodes: DataFrame | None = None, include_pits: bool = True) -> DataFrame:
    """One row, value: the sum over nodes that are their own receiver; without pits, only where flow may leave."""
    at = sfd.filter("node = rec").select("node")
    if not include_pits:
        at = at.join(nodes, "node").filter(B.can_out(F.col("bc"))).select("node")
    return values.join(at, "node").agg(F.sum("value").alias("value"))


def keep_at_outlets(sfd: DataFrame, values: DataFrame) -> DataFrame:
    return values.join(sfd.select("node", "rec"), "node").select("node", F.when(F.col("node") == F.col("rec"), F.col("value")).otherwise(F.lit(0)).alias("value"))


# distances


def distance_to_outlet(sfd: DataFrame) -> DataFrame:
    return to_root(sfd).select("node", F.col("length").alias("value"))


def distance_from_sources(sfd: DataFrame, longest: bool) -> DataFrame:
    """node, value: the longest or shortest path from a node without donors, 0 there (and not a mark for unset)."""
    donors = sfd.filter("node <> rec").select(F.col("rec").alias("node")).distinct()
    start = sfd.select("node").join(donors.withColumn("_d", F.lit(True)), "node", "left").select("node", F.when(F.col("_d").isNull(), F.lit(0.0)).alias("value"))
    merge = (lambda a, b: F.greatest(a, b)) if longest else (lambda a, b: F.least(a, b))
    return upstream_fold(sfd, start, F.max if longest else F.min, merge, lambda v, d: v + d)


def mfd_distance(edges: DataFrame, nodes: DataFrame, longest: bool, from_sources: bool, level: DataFrame | None = None, spec: GridSpec | None = None) -> DataFrame:
    """node, value: longest or shortest path over all receivers, from nodes without donors or from those without receivers.
    With the grid it goes by tiles, else level by level."""
    ends = edges.select((F.col("nb") if from_sources else F.col("node")).alias("node")).distinct().withColumn("_e", F.lit(True))
    start = nodes.select("node").join(ends, "node", "left").select("node", F.when(F.col("_e").isNull(), F.lit(0.0)).alias("value"))
    if spec is not None:
        return propagate(edges, start, spec, "max" if longest else "min", F.col("dx"), downstream=from_sources)
    level = levels(edges, nodes) if level is None else level
    merge = (lambda a, b: F.greatest(a, b)) if longest else (lambda a, b: F.least(a, b))
    return level_loop(edges, start, level, F.col("value") + F.col("dx"), F.max if longest else F.min, merge, downstream=from_sources)


# basins, closures, masks


def basins(sfd: DataFrame) -> DataFrame:
    """node, root, basin: the end of each node's path, and basins numbered from 0 by root.

    Numbers come from counts by blocks of roots, so no task sees all roots."""
    root = to_root(sfd).select("node", "root")
    roots = sfd.filter("node = rec").select(F.col("node").alias("root")).withColumn("block", F.floor(F.col("root") / 65536))
    size = roots.groupBy("block").agg(F.count(F.lit(1)).alias("k"))
    first = size.selectExpr("block", "sum(k) over (order by block) - k as first")
    numbered = roots.join(first, "block").selectExpr("root", "first + row_number() over (partition by block order by root) - 1 as basin")
    return root.join(numbered, "root").select("node", "root", F.col("basin").cast("long").alias("basin"))


def basin_boxes(basin: DataFrame, spec: GridSpec) -> DataFrame:
    """root, n, r_min, r_max, c_min, c_max of every basin; the root is its outlet."""
    rc = spec.with_rowcol(basin)
    return rc.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))


def upstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, step of all nodes that drain to the starts, which aren't among them."""
    return reach(edges.filter("node <> nb"), starts, "nb", "node").filter("step > 0")


def downstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return reach(edges.filter("node <> nb"), starts, "node", "nb").filter("step > 0")


def watershed(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """Nodes that drain to the outlets, which are among them."""
    return reach(edges.filter("node <> nb"), outlets, "nb", "node")


def as_edges(sfd: DataFrame) -> DataFrame:
    """A single-flow table as edges to receivers."""
    return sfd.filter("node <> rec").select("node", F.col("rec").alias("nb"), "dx", "slope")


def flow_path(sfd: DataFrame, start: int, max_steps: int = 1000) -> DataFrame:
    """step, node of the path of steepest descent from one node, at most ``max_steps`` steps (a stated limit)."""
    spark = sfd.sparkSession
    seeds = spark.createDataFrame([(start,)], "node long").join(sfd.select("node"), "node", "left_semi")
    return reach(as_edges(sfd), seeds, limit=max_steps).select("step", "node")


def upstream_by_elevation(nodes: DataFrame, spec: GridSpec, starts: DataFrame) -> DataFrame:
    """Nodes reached from the starts by neighbours that are at least as high."""
    e = neighbours(nodes, spec, values=["z"]).filter("z_nb >= z")
    return reach(e, starts)


def mask_by_area(area: DataFrame, least: float) -> DataFrame:
    """node, mask: whether drained area is at least ``least``."""
    return area.select("node", (F.col("value") >= least).alias("mask"))


def basins_by_area(sfd: DataFrame, area: DataFrame, least: float) -> DataFrame:
    """node, mask: nodes of basins whose outlet drains at least ``least``."""
    big = area.join(sfd.filter("node = rec").select("node"), "node").filter(F.col("value") >= least).select(F.col("node").alias("root"))
    return to_root(sfd).select("node", "root").join(big.withColumn("_m", F.lit(True)), "root", "left").select("node", F.col("_m").isNotNull().alias("mask"))


def basins_in_mask(sfd: DataFrame, mask: DataFrame) -> DataFrame:
    """node, root of the flow inside a mask (node, mask): a receiver outside ends the path."""
    inside = mask.filter("mask").select("node")
    s = sfd.join(inside, "node").join(inside.select(F.col("node").alias("rec"), F.lit(True).alias("_i")), "rec", "left")
    s = s.select("node", F.when(F.col("_i").isNotNull(), F.col("rec")).otherwise(F.col("node")).alias("rec"), "dx", "slope")
    return to_root(s).select("node", "root")


def boundaries_of_mask(nodes: DataFrame, mask: DataFrame, spec: GridSpec, code: int = B.CAN_OUT) -> DataFrame:
    """node, bc: no data outside a mask, ``code`` at its edge (a neighbour outside, or the grid's edge), flow inside."""
    m = nodes.select("node").join(mask, "node", "left").select("node", F.coalesce("mask", F.lit(False)).alias("mask"))
    inner = neighbours(m, spec, values=["mask"]).filter("mask and mask_nb").groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    out = m.join(inner, "node", "left")
    return out.select("node", F.when(~F.col("mask"), B.NO_FLOW).when(F.coalesce("k", F.lit(0)) < 8, code).otherwise(B.FLOW).cast("byte").alias("bc"))


def recast_below(nodes: DataFrame, level: float, code: int = B.NO_FLOW) -> DataFrame:
    """nodes with bc = ``code`` where z is below ``level``."""
    return nodes.withColumn("bc", F.when(F.col("z") < level, F.lit(code)).otherwise(F.col("bc")).cast("byte"))


def only_upstream_of(nodes: DataFrame, edges: DataFrame, outlet: int) -> DataFrame:
    """nodes with no data outside the watershed of one outlet, which becomes OUT."""
    w = watershed(edges, nodes.filter(F.col("node") == outlet).select("node")).select("node").withColumn("_w", F.lit(True))
    out = nodes.join(w, "node", "left")
    code = F.when(F.col("_w").isNull(), B.NO_FLOW).when(F.col("node") == outlet, B.OUT).otherwise(F.col("bc"))
    return out.withColumn("bc", code.cast("byte")).drop("_w")


def remove_seas(nodes: DataFrame, spec: GridSpec, level: float = 0.0) -> DataFrame:
    """nodes with no data at or below ``level`` and CAN_OUT beside them."""
    sea = nodes.withColumn("_s", F.col("z") <= level)
    coast = neighbours(sea.select("node", "_s"), spec, values=["_s"]).filter("not _s and _s_nb").select("node").distinct().withColumn("_c", F.lit(True))
    out = sea.join(coast, "node", "left")
    return out.withColumn("bc", F.when(F.col("_s"), B.NO_FLOW).when(F.col("_c").isNotNull(), B.CAN_OUT).otherwise(F.col("bc")).cast("byte")).drop("_s", "_c")


def local_relief(nodes: DataFrame, spec: GridSpec, radius: float) -> DataFrame:
    """node, relief: the largest difference of elevation to a cell whose centre is within ``radius``.

    Every cell is sent to the cells around it, so the cost grows with the square of radius / cell size."""
    k, m = int(radius // spec.dy), int(radius // spec.dx)
    ring = [(0, r, c) for r in range(-k, k + 1) for c in range(-m, m + 1) if (r or c) and (r * spec.dy) ** 2 + (c * spec.dx) ** 2 <= radius**2]
    e = neighbours(nodes, spec, ring, values=["z"])
    best = e.groupBy("node").agg(F.max(F.abs(F.col("z") - F.col("z_nb"))).alias("relief"))
    return nodes.select("node").join(best, "node", "left").select("node", F.coalesce("relief", F.lit(0)).alias("relief"))


def nodes_within(nodes: DataFrame, spec: GridSpec, r: int, c: int, radius: float) -> DataFrame:
    rc = spec.with_rowcol(nodes)
    return rc.filter(distance(spec, F.col("r"), F.col("c"), F.lit(r), F.lit(c)) <= radius).select("node")


def nodes_in_rectangle(nodes: DataFrame, spec: GridSpec, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    rc = spec.with_rowcol(nodes)
    return rc.filter(F.col("r").between(min(r1, r2), max(r1, r2)) & F.col("c").between(min(c1, c2), max(c1, c2))).select("node")


def height_above(sfd: DataFrame, nodes: DataFrame, mask: DataFrame) -> DataFrame:
    """node, target, height, length: each node's first node of the mask downstream, the sum of positive drops on
    the way, and how far it is; null where the path meets none."""
    z = nodes.select("node", F.col("z").alias("z"))
    inside = mask.filter("mask").select("node", F.lit(True).alias("_m"))
    s = sfd.join(inside, "node", "left").select("node", F.when(F.col("_m").isNotNull(), F.col("node")).otherwise(F.col("rec")).alias("rec"), "dx")
    s = s.join(z, "node").join(z.select(F.col("node").alias("rec"), F.col("z").alias("z_rec")), "rec")
    s = s.select("node", "rec", "dx", F.greatest(F.col("z") - F.col("z_rec"), F.lit(0)).cast("double").alias("drop"))
    up = to_root(s, F.col("drop")).select("node", "root", F.col("length").alias("height"))
    far = to_root(s).select("node", "length")
    out = up.join(far, "node").join(inside.select(F.col("node").alias("root"), "_m"), "root", "left")
    return out.select("node", *[F.when(F.col("_m").isNotNull(), F.col(a)).alias(b) for a, b in (("root", "target"), ("height", "height"), ("length", "length"))])
