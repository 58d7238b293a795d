"""Building boundary types: presets, masks, seas, ridges, outlets and updates (second numbering)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import GridSpec
from ..functions.vectors import noise
from ..scratch import cut
from .neighbours import neighbours


def filled(nodes: DataFrame, kind: int = B.NORMAL) -> DataFrame:
    return nodes.withColumn("node_type", F.lit(kind).cast("byte"))


def set_where(nodes: DataFrame, where: Column, kind: int) -> DataFrame:
    """User predicate: any condition over the columns of nodes."""
    return nodes.withColumn("node_type", F.when(where, F.lit(kind)).otherwise(F.col("node_type")).cast("byte"))


def borders(nodes: DataFrame, spec: GridSpec, kind: int, sides: str = "NSEW") -> DataFrame:
    r, c = spec.row(F.col("node")), spec.col(F.col("node"))
    tests = {"N": spec.is_top(r), "S": spec.is_bottom(r), "W": spec.is_left(c), "E": spec.is_right(c)}
    where = F.lit(False)
    for s in sides:
        where = where | tests[s]
    return set_where(nodes, where, kind)


#: Presets: (sides, type) in order.
PRESETS = {
    "open": [("NSEW", B.T_CAN_OUT)],
    "closed": [("NSEW", B.REFLECT)],
    "periodic_ew": [("EW", B.PERIODIC), ("NS", B.T_CAN_OUT)],
    "periodic_ns": [("NS", B.PERIODIC), ("EW", B.T_CAN_OUT)],
    "periodic_ew_closed": [("EW", B.PERIODIC), ("NS", B.REFLECT)],
    "periodic_ns_closed": [("NS", B.PERIODIC), ("EW", B.REFLECT)],
    "inlet_outlet": [("NSEW", B.REFLECT), ("N", B.T_IN), ("S", B.HAS_TO_OUT)],
}


def preset(nodes: DataFrame, spec: GridSpec, name: str) -> DataFrame:
    out = filled(nodes)
    if name == "corners":
        out = borders(out, spec, B.REFLECT)
        r, c = spec.row(F.col("node")), spec.col(F.col("node"))
        return set_where(out, (spec.is_top(r) | spec.is_bottom(r)) & (spec.is_left(c) | spec.is_right(c)), B.HAS_TO_OUT)
    if name == "centre":
        out = borders(out, spec, B.REFLECT)
        return set_where(out, F.col("node") == (spec.ny // 2) * spec.nx + spec.nx // 2, B.HAS_TO_OUT)
    for sides, kind in PRESETS[name]:
        out = borders(out, spec, kind, sides)
    return out


def codes(nodes: DataFrame, spec: GridSpec, name: str = "4edges", permissive: bool = False) -> DataFrame:
    """nodes with boundary codes (first numbering): 4edges, periodic_EW or periodic_NS; edges let out, or may if permissive."""
    r, c = spec.row(F.col("node")), spec.col(F.col("node"))
    out = B.CAN_OUT if permissive else B.OUT
    ns, ew = spec.is_top(r) | spec.is_bottom(r), spec.is_left(c) | spec.is_right(c)
    code = {
        "4edges": F.when(ns | ew, out),
        "periodic_EW": F.when(ns, out).when(ew, B.PERIODIC_BORDER),
        "periodic_NS": F.when(ew, out).when(ns, B.PERIODIC_BORDER),
    }[name].otherwise(B.FLOW)
    return nodes.withColumn("bc", code.cast("byte"))


def random_outlets(nodes: DataFrame, spec: GridSpec, n: int, seed: int = 0) -> DataFrame:
    """REFLECT borders and n cells anywhere that have to let out, drawn by a seeded hash."""
    drawn = nodes.select("node").orderBy(noise(seed, F.col("node")), "node").limit(n).withColumn("_o", F.lit(True))
    out = borders(filled(nodes), spec, B.REFLECT).join(F.broadcast(drawn), "node", "left")
    return set_where(out, F.col("_o").isNotNull(), B.HAS_TO_OUT).drop("_o")


def extreme_nodes(nodes: DataFrame, n: int, highest: bool = False) -> DataFrame:
    """The n lowest or highest active nodes (a top-k); ties by node, both keys falling for the highest."""
    order = [F.col("z").desc(), F.col("node").desc()] if highest else [F.col("z"), F.col("node")]
    return nodes.filter(B.type_is_active(F.col("node_type"))).orderBy(*order).limit(n).select("node")


def mark_extremes(nodes: DataFrame, n: int, highest: bool = False) -> DataFrame:
    """Lowest nodes have to let out, or highest nodes are inlets."""
    out = nodes.join(F.broadcast(extreme_nodes(nodes, n, highest).withColumn("_e", F.lit(True))), "node", "left")
    return set_where(out, F.col("_e").isNotNull(), B.T_IN if highest else B.HAS_TO_OUT).drop("_e")


def touching(nodes: DataFrame, spec: GridSpec, kind: int) -> DataFrame:
    """node of the nodes with a neighbour of a type."""
    return neighbours(nodes.select("node", "node_type"), spec, values=["node_type"]).filter(F.col("node_type_nb") == kind).select("node").distinct()


def sea_level(nodes: DataFrame, spec: GridSpec, level: float) -> DataFrame:
    """No data at or below the level; NORMAL nodes that touch it may let out."""
    out = cut(set_where(nodes, F.col("z") <= level, B.NO_DATA))
    coast = touching(out, spec, B.NO_DATA).withColumn("_c", F.lit(True))
    out = out.join(coast, "node", "left")
    return set_where(out, F.col("_c").isNotNull() & (F.col("node_type") == B.NORMAL), B.T_CAN_OUT).drop("_c")


def ridges(nodes: DataFrame, threshold: float) -> DataFrame:
    return set_where(nodes, F.col("z") >= threshold, B.REFLECT)


def valleys(nodes: DataFrame, spec: GridSpec, tolerance: float = 0.0) -> DataFrame:
    """Inner nodes whose active neighbours all are at least ``tolerance`` higher have to let out."""
    active = nodes.filter(B.type_is_active(F.col("node_type")))
    low = neighbours(active.select("node", "z"), spec, values=["z"]).groupBy("node").agg(F.min(F.col("z_nb") - F.col("z")).alias("_d"))
    out = nodes.join(low, "node", "left")
    inner = ~spec.on_edge(spec.row(F.col("node")), spec.col(F.col("node")))
    return set_where(out, inner & (F.col("_d") >= tolerance), B.HAS_TO_OUT).drop("_d")


def mask(nodes: DataFrame, inside: Column) -> DataFrame:
    """No data outside a condition over node, r, c and the columns of nodes."""
    return set_where(nodes, ~inside, B.NO_DATA)


def circle(spec: GridSpec, r: int, c: int, radius: float) -> Column:
    return F.hypot(spec.row(F.col("node")) - r, spec.col(F.col("node")) - c) <= radius


def diamond(spec: GridSpec, r: int, c: int, radius: float) -> Column:
    return F.abs(spec.row(F.col("node")) - r) + F.abs(spec.col(F.col("node")) - c) <= radius


def rectangle(spec: GridSpec, r1: int, c1: int, r2: int, c2: int) -> Column:
    return spec.row(F.col("node")).between(r1, r2) & spec.col(F.col("node")).between(c1, c2)


def fix_borders(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """NORMAL nodes beside no data or at the grid's edge may let out."""
    near = touching(nodes, spec, B.NO_DATA).withColumn("_n", F.lit(True))
    out = nodes.join(near, "node", "left")
    edge = spec.on_edge(spec.row(F.col("node")), spec.col(F.col("node")))
    return set_where(out, (F.col("node_type") == B.NORMAL) & (edge | F.col("_n").isNotNull()), B.T_CAN_OUT).drop("_n")


def expand(nodes: DataFrame, spec: GridSpec, kind: int, cells: int = 1) -> DataFrame:
    """A type grows into NORMAL nodes, a cell in each round."""
    for _ in range(cells):
        near = touching(nodes, spec, kind).withColumn("_n", F.lit(True))
        out = nodes.join(near, "node", "left")
        nodes = cut(set_where(out, (F.col("node_type") == B.NORMAL) & F.col("_n").isNotNull(), kind).drop("_n"))
    return nodes


def smooth(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """An inner node takes the type most of its neighbours have if that beats its own type's count by more than 2."""
    e = neighbours(nodes.select("node", "node_type"), spec, values=["node_type"])
    n = e.groupBy("node", F.col("node_type_nb").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.max("node_type").alias("own"))
    top = n.groupBy("node").agg(F.max(F.struct("n", (-F.col("t")).alias("m"))).alias("b"), F.coalesce(F.max(F.when(F.col("t") == F.col("own"), F.col("n"))), F.lit(0)).alias("mine"))
    out = nodes.join(top, "node", "left")
    inner = ~spec.on_edge(spec.row(F.col("node")), spec.col(F.col("node")))
    kind = F.when(inner & (F.col("b.n") > F.col("mine") + 2), -F.col("b.m")).otherwise(F.col("node_type"))
    return out.withColumn("node_type", kind.cast("byte")).drop("b", "mine")


def near_points(nodes: DataFrame, spec: GridSpec, points: DataFrame, radius: float, kind: int) -> DataFrame:
    """A type for nodes within ``radius`` cells of points (r, c): points are sent to the cells around them."""
    k = int(radius)
    ring = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-k, k + 1) for c in range(-k, k + 1) if r * r + c * c <= radius * radius])
    hit = points.select("r", "c", F.explode(ring).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    hit = hit.filter(F.col("r").between(0, spec.ny - 1) & F.col("c").between(0, spec.nx - 1)).select(spec.node(F.col("r"), F.col("c")).alias("node")).distinct().withColumn("_p", F.lit(True))
    return set_where(nodes.join(hit, "node", "left"), F.col("_p").isNotNull(), kind).drop("_p")


def count_types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n")).withColumn("name", B.type_name(F.col("node_type")))


def validate(nodes: DataFrame, spec: GridSpec) -> dict[str, bool]:
    """Whether every cell has a known type, some flow may leave, and periodic nodes are at the edge."""
    edge = spec.on_edge(spec.row(F.col("node")), spec.col(F.col("node")))
    r = nodes.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("node_type").between(0, 6), 1)).alias("known"),
        F.count(F.when(B.allows_outflow(F.col("node_type")), 1)).alias("out"),
        F.count(F.when((F.col("node_type") == B.PERIODIC) & ~edge, 1)).alias("stray"),
    ).first()
    return {"complete": r["n"] == spec.size, "known": r["known"] == r["n"], "drains": r["out"] > 0, "periodic_at_edge": r["stray"] == 0}


def fault_line(spec: GridSpec, r1: float, c1: float, r2: float, c2: float, width: float) -> Column:
    """Whether a node is within ``width`` cells of the line through two points."""
    r, c = spec.row(F.col("node")), spec.col(F.col("node"))
    length = ((r2 - r1) ** 2 + (c2 - c1) ** 2) ** 0.5
    return F.abs((c - c1) * (r2 - r1) - (r - r1) * (c2 - c1)) / length <= width


def islands(spec: GridSpec, centres: list[tuple[int, int]], radius: float) -> Column:
    """Whether a node is in any of some circles."""
    out = F.lit(False)
    for r, c in centres:
        out = out | circle(spec, r, c, radius)
    return out


def river_system(nodes: DataFrame, river: DataFrame, kind: int = B.HAS_TO_OUT) -> DataFrame:
    """A type for the ends of a river network (node, receiver): its nodes that are their own receiver."""
    ends = river.filter("node = receiver").select("node").withColumn("_e", F.lit(True))
    return set_where(nodes.join(ends, "node", "left"), F.col("_e").isNotNull(), kind).drop("_e")


def divide_nodes(nodes: DataFrame, divides: DataFrame, kind: int = B.REFLECT) -> DataFrame:
    """A type for the nodes of drainage divides."""
    on = divides.select("node").distinct().withColumn("_d", F.lit(True))
    return set_where(nodes.join(on, "node", "left"), F.col("_d").isNotNull(), kind).drop("_d")


def elevation_range(nodes: DataFrame, low: float, high: float, kind: int) -> DataFrame:
    return set_where(nodes, F.col("z").between(low, high), kind)
