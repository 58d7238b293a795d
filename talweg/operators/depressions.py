"""Local minima: filling, sinks, basin passes, rerouting, carving and lakes."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import D8, GridSpec
from ..scratch import cut
from . import spanning
from .flow import downhill, steepest
from .iterate import to_root
from .neighbours import neighbours, offsets
from .parts import least, tile_of

#: Passes between basins that are solved on the driver; with more of them, tiles do it.
DRIVER_PASSES = 200_000


def basin_passes(nodes: DataFrame, sfd: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8) -> DataFrame:
    """b1, b2, pass_z, node_from, node_to: for each pair of neighbouring basins (b1 < b2, by root) the lowest
    pass, which is the higher of two neighbouring nodes; ties go to the smallest nodes."""
    root = to_root(sfd).select("node", F.col("root").alias("b"))
    half = [o for o in around if o[1:] > (0, 0)] if {o[1:] for o in around} == {(-o[1], -o[2]) for o in around} else around
    e = neighbours(nodes.select("node", "z").join(root, "node"), spec, half, ["z", "b"]).filter("b <> b_nb")
    if half is not around:  # each pair of neighbours came once, from either side
        first = F.col("b") < F.col("b_nb")
        e = e.select(F.least("b", "b_nb").alias("b"), F.greatest("b", "b_nb").alias("b_nb"), "z", "z_nb", F.when(first, F.col("node")).otherwise(F.col("nb")).alias("node"), F.when(first, F.col("nb")).otherwise(F.col("node")).alias("nb"))
    e = e.filter("b < b_nb")
    best = e.groupBy(F.col("b").alias("b1"), F.col("b_nb").alias("b2")).agg(F.min(F.struct(F.greatest("z", "z_nb").alias("pass_z"), F.col("node").alias("node_from"), F.col("nb").alias("node_to"))).alias("p"))
    return best.select("b1", "b2", "p.pass_z", "p.node_from", "p.node_to")


def open_roots(nodes: DataFrame, sfd: DataFrame) -> DataFrame:
    """Roots that may let flow out of the model."""
    return sfd.filter("node = rec").select("node").join(nodes, "node").filter(B.can_out(F.col("bc"))).select(F.col("node").alias("root"))


def _to_out(passes: DataFrame, outlets: DataFrame) -> DataFrame:
    """Passes as edges whose ends at open basins are OUT; an open basin gains nothing by another."""
    open_ = outlets.select("root").distinct()
    out = passes.join(open_.select(F.col("root").alias("b1"), F.lit(True).alias("_1")), "b1", "left").join(open_.select(F.col("root").alias("b2"), F.lit(True).alias("_2")), "b2", "left")
    u, v = (F.when(F.col(o).isNotNull(), F.lit(spanning.OUT)).otherwise(F.col(b)) for b, o in (("b1", "_1"), ("b2", "_2")))
    return out.select(u.alias("u"), v.alias("v"), F.col("pass_z").alias("w"), F.least("node_from", "node_to").alias("k1"), F.greatest("node_from", "node_to").alias("k2"))


def spill_levels(passes: DataFrame, outlets: DataFrame, spec: GridSpec) -> DataFrame:
    """root, spill: for each basin the least height over which its water reaches an open basin, null for an open one.

    Up to DRIVER_PASSES passes are solved on the driver by a heap. Beyond that it is the greatest height on the way along
    the minimum spanning tree of basins and passes, which is found by tiles, to which basins belong by their roots
    (``spanning``): a few rounds, whatever the ways' lengths.
    """
    spark = passes.sparkSession
    passes = cut(passes)
    kind = passes.schema["pass_z"].dataType.simpleString()
    if passes.count() <= DRIVER_PASSES and outlets.count() <= DRIVER_PASSES:
        graph: dict[int, list[tuple[float, int]]] = {}
        for r in passes.select("b1", "b2", "pass_z").collect():
            graph.setdefault(r[0], []).append((r[2], r[1]))
            graph.setdefault(r[1], []).append((r[2], r[0]))
        level: dict[int, float] = {}
        lowest = -(1 << 62)
        heap = [(lowest, r[0]) for r in outlets.select("root").collect()]
        heapq.heapify(heap)
        while heap:
            h, b = heapq.heappop(heap)
            if b in level:
                continue
            level[b] = h
            for p, other in graph.get(b, ()):
                if other not in level:
                    heapq.heappush(heap, (max(h, p), other))
        rows = [(b, None if h == lowest else h) for b, h in level.items()]
        return spark.createDataFrame(rows, f"root long, spill {kind}")
    found = spanning.ways_out(spanning.forest(_to_out(passes, outlets), spec), spec)
    return found.select(F.col("node").alias("root"), F.col("value").cast(kind).alias("spill")).unionAll(outlets.select("root", F.lit(None).cast(kind).alias("spill")))


def fill(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8, sfd: DataFrame | None = None) -> DataFrame:
    """node, z, filled: the lowest surface without depressions, z where there is none to fill.

    The result of a priority flood: each node's least maximum height on the way to a node that may let flow out.
    From within a basin flow descends to its root for nothing, so only basins and the passes between them are
    searched. Nodes that can't reach an outlet keep z.
    """
    plain = nodes.select("node", "z", "bc") if "bc" in nodes.columns else nodes.select("node", "z")
    flow = cut(steepest(plain.select("node", "z"), spec, around) if sfd is None else sfd)
    if "bc" in nodes.columns:
        leaving = nodes.filter(B.can_out(F.col("bc"))).select("node")
    else:
        rc = spec.with_rowcol(nodes)
        leaving = rc.filter(spec.on_edge(F.col("r"), F.col("c"))).select("node")
    # an outlet ends every path that comes to it, even where lower neighbours go on
    flow = flow.join(leaving.withColumn("_o", F.lit(True)), "node", "left").select("node", F.when(F.col("_o").isNotNull(), F.col("node")).otherwise(F.col("rec")).alias("rec"), "dx", "slope")
    flow = cut(flow)
    spill = spill_levels(basin_passes(plain, flow, spec, around), leaving.select(F.col("node").alias("root")), spec)
    root = to_root(flow).select("node", "root")
    out = nodes.select("node", "z").join(root, "node").join(spill, "root", "left")
    return out.select("node", "z", F.greatest("z", "spill").alias("filled"))


def fill_by_relaxation(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8) -> DataFrame:
    """node, z, filled by the fixpoint W = max(z, least W of the neighbours), W = z at outlets, relaxed by tiles: one
    round for each tile that a way out crosses. A check of fill()."""
    leaving = B.can_out(F.col("bc")) if "bc" in nodes.columns else spec.on_edge(spec.row(F.col("node")), spec.col(F.col("node")))
    e = offsets(nodes, spec, around).select("node", "nb").join(nodes.select(F.col("node").alias("nb"), F.col("z").alias("z_nb")), "nb")
    w = least(e, nodes.filter(leaving).select("node", F.col("z").alias("value")), lambda n: tile_of(n, spec), F.col("z_nb"), "max")
    return nodes.select("node", "z").join(w, "node", "left").select("node", "z", F.coalesce("value", "z").alias("filled"))


def lake_depth(filled: DataFrame) -> DataFrame:
    return filled.select("node", (F.col("filled") - F.col("z")).alias("depth"))


def sinks(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8) -> DataFrame:
    """node of the inner nodes that have no lower neighbour."""
    rc = spec.with_rowcol(nodes)
    inner = rc.filter(~B.can_out(F.col("bc"))) if "bc" in nodes.columns else rc.filter(~spec.on_edge(F.col("r"), F.col("c")))
    return inner.select("node").join(downhill(nodes.select("node", "z"), spec, around).select("node"), "node", "left_anti")


def flood_report(filled: DataFrame) -> DataFrame:
    """One row: nodes, filled nodes, volume by cell, and the deepest fill."""
    d = F.col("filled") - F.col("z")
    return filled.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(d > 0, 1)).alias("n_filled"), F.sum(d).alias("volume"), F.max(d).alias("deepest"))


def reroute(nodes: DataFrame, sfd: DataFrame, spec: GridSpec, carve: bool = True, around: list[tuple[int, int, int]] = D8, method: str | None = None) -> DataFrame:
    """node, rec, dx, slope with every closed basin drained over its lowest pass (Cordonnier and others, 2019).

    ``method``: "carve", "simple" (as ``carve`` tells where it isn't given) or "fill".

    Each closed basin drains along the minimum spanning tree of basins and passes to an open basin. Then the way from each pit to its pass is reversed (carve), or the pit drains
    straight to the far side of the pass (simple), or all nodes below the pass flow to it as over a lake (fill).
    Basins without a way out stay as they are.
    """
    method = method or ("carve" if carve else "simple")
    if method not in ("carve", "simple", "fill"):
        raise ValueError(f"unknown method {method}")
    passes = cut(basin_passes(nodes, sfd, spec, around))
    roots = open_roots(nodes, sfd)
    both = passes.select(F.col("b1").alias("b"), F.col("b2").alias("o"), "pass_z", F.col("node_from").alias("here"), F.col("node_to").alias("there"))
    both = both.unionAll(passes.select(F.col("b2").alias("b"), F.col("b1").alias("o"), "pass_z", F.col("node_to").alias("here"), F.col("node_from").alias("there")))
    edges = cut(both)
    # orient from the open basins: a basin is entered over the pass by which a flood would reach it
    exits = _flood_order(passes, edges, roots, spec)
    if method == "carve":
        return _reverse(sfd, exits, spec)
    if method == "fill":
        return _flooded(nodes, sfd, exits, spec, around)
    moved = exits.select(F.col("b").alias("node"), F.col("there").alias("rec2"))
    out = sfd.join(moved, "node", "left")
    dx = F.when(F.col("rec2").isNotNull(), _length(spec, F.col("node"), F.col("rec2"))).otherwise(F.col("dx"))
    return out.select("node", F.coalesce("rec2", "rec").alias("rec"), dx.alias("dx"), F.when(F.col("rec2").isNotNull(), 0.0).otherwise(F.col("slope")).alias("slope"))


def _length(spec: GridSpec, a, b):
    dr, dc = F.abs(spec.row(a) - spec.row(b)), F.abs(spec.col(a) - spec.col(b))
    if spec.periodic_ns:
        dr = F.least(dr, spec.ny - dr)
    if spec.periodic_ew:
        dc = F.least(dc, spec.nx - dc)
    return F.hypot(dr * spec.dy, dc * spec.dx)


def _flood_order(passes: DataFrame, edges: DataFrame, roots: DataFrame, spec: GridSpec) -> DataFrame:
    """b, here, there, pass_z: the pass over which each closed basin drains: minimum spanning tree, oriented to the open basins."""
    found = spanning.ways_out(spanning.forest(_to_out(passes, roots), spec), spec).select(F.col("node").alias("b"), "k1", "k2")
    sides = edges.select("b", "here", "there", "pass_z", F.least("here", "there").alias("k1"), F.greatest("here", "there").alias("k2"))
    return cut(found.join(sides, ["b", "k1", "k2"]).select("b", "here", "there", "pass_z"))


def _flooded(nodes: DataFrame, sfd: DataFrame, exits: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]]) -> DataFrame:
    """Receivers over lakes: the nodes of a closed basin below its pass, and the pass's own node, by steps from that node
    over such nodes; each flows to a neighbour that is a step nearer, the nearest one, then the smallest."""
    root = to_root(sfd).select("node", F.col("root").alias("b"))
    wet = nodes.select("node", "z").join(root, "node").join(exits, "b")
    wet = cut(wet.filter((F.col("z") < F.col("pass_z")) | (F.col("node") == F.col("here"))).select("node", "b", "here", "there"))
    e = offsets(wet, spec, around).select("node", "nb", "dx").join(wet.select("node", "b"), "node").join(wet.select(F.col("node").alias("nb"), F.col("b").alias("b_nb")), "nb")
    e = cut(e.filter("b = b_nb").select("node", "nb", "dx"))
    far = least(e, wet.filter("node = here").select("node", F.lit(0.0).alias("value")), lambda n: tile_of(n, spec))
    nearer = e.join(far, "node").join(far.select(F.col("node").alias("nb"), F.col("value").alias("v")), "nb").filter("v = value - 1")
    nearer = nearer.groupBy("node").agg(F.min(F.struct("dx", "nb")).alias("m")).select("node", F.col("m.nb").alias("rec2"))
    moved = nearer.unionAll(wet.filter("node = here").select("node", F.col("there").alias("rec2")))
    out = sfd.join(moved, "node", "left")
    dx = F.when(F.col("rec2").isNotNull(), _length(spec, F.col("node"), F.col("rec2"))).otherwise(F.col("dx"))
    return out.select("node", F.coalesce("rec2", "rec").alias("rec"), dx.alias("dx"), F.when(F.col("rec2").isNotNull(), 0.0).otherwise(F.col("slope")).alias("slope"))


def _reverse(sfd: DataFrame, exits: DataFrame, spec: GridSpec) -> DataFrame:
    """Reverse the receivers on the way from each exit node down to its root, and send the exit node over the pass."""
    flow = cut(sfd.filter("node <> rec").select("node", F.col("rec").alias("to")))
    ways, jump = cut(exits.select(F.col("here").alias("node"))), flow
    while True:  # after k rounds all nodes less than 2^k steps down from the exits
        more = cut(ways.join(jump, "node").select(F.col("to").alias("node")))
        if more.isEmpty():
            break
        ways = cut(ways.unionAll(more))
        jump = cut(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("to2")), "to").select("node", F.col("to2").alias("to")))
    on_way = ways.join(flow, "node").select(F.col("to").alias("node"), F.col("node").alias("rec2"))
    on_way = exits.select(F.col("here").alias("node"), F.col("there").alias("rec2")).unionAll(on_way)
    out = sfd.join(cut(on_way), "node", "left")
    dx = F.when(F.col("rec2").isNotNull(), _length(spec, F.col("node"), F.col("rec2"))).otherwise(F.col("dx"))
    return out.select("node", F.coalesce("rec2", "rec").alias("rec"), dx.alias("dx"), F.when(F.col("rec2").isNotNull(), 0.0).otherwise(F.col("slope")).alias("slope"))


def carve(nodes: DataFrame, sfd: DataFrame, min_slope: float = 0.0) -> DataFrame:
    """node, z, carved: the surface cut down so that no receiver is higher than its donors: the least elevation
    upstream, less ``min_slope`` by unit of path."""
    from .iterate import upstream_fold

    start = nodes.select("node", F.col("z").cast("double").alias("value"))
    low = upstream_fold(sfd, start, F.min, lambda a, b: F.least(a, b), lambda v, d: v - d * min_slope)
    return nodes.select("node", "z").join(low, "node").select("node", "z", F.least(F.col("z"), F.col("value")).alias("carved"))


def raise_to_receivers(nodes: DataFrame, sfd: DataFrame, slope: float = 0.0) -> DataFrame:
    """node, z, raised: the surface raised along receivers: at least the highest elevation downstream, plus
    ``slope`` by unit of path to it. Pointer doubling from each node towards its root."""
    at = cut(sfd.select("node", F.col("rec").alias("to"), F.when(F.col("node") == F.col("rec"), F.lit(0.0)).otherwise(F.col("dx")).alias("d")).join(nodes.select("node", F.col("z").cast("double").alias("top")), "node"))
    while True:
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("top").alias("top2"))
        nxt = cut(at.join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.greatest(F.col("top"), F.col("top2") + F.col("d") * slope).alias("top"), (F.col("to") != F.col("to2")).alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nodes.select("node", "z").join(nxt.select("node", "top"), "node").select("node", "z", F.col("top").alias("raised"))
        at = nxt.drop("moved")


def has_drainage(nodes: DataFrame, spec: GridSpec) -> bool:
    return sinks(nodes, spec).isEmpty()


def epsilon(spec: GridSpec, relief: float) -> float:
    """A step for flats that adds less than a thousandth of the relief over the grid's longest way."""
    return relief / (1000.0 * max(spec.size, 1))
