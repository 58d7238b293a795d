"""Neighbourhoods: computed neighbour ids, one equi-join for their values, links and stencils."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import D4, D8, DIRECTIONS, GridSpec

#: The four link directions of a node: right, bottom right, bottom, bottom left.
LINKS = [(4, 0, 1), (7, 1, 1), (6, 1, 0), (5, 1, -1)]


def offsets(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8, values: list[str] | None = None) -> DataFrame:
    """node, nb, dir, dr, dc, dx of every neighbour in the grid, with the node's ``values``: ids are computed, nothing is joined."""
    values = values or []
    rows = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(spec.length(dr, dc)).alias("dx")) for d, dr, dc in around])
    out = spec.with_rowcol(nodes.select("node", *values)).select("node", "r", "c", *values, F.explode(rows).alias("o"))
    r, c = F.col("r") + F.col("o.dr"), F.col("c") + F.col("o.dc")
    if spec.periodic_ns:
        r = F.pmod(r, F.lit(spec.ny))
    if spec.periodic_ew:
        c = F.pmod(c, F.lit(spec.nx))
    inside = r.between(0, spec.ny - 1) & c.between(0, spec.nx - 1)
    out = out.filter(inside).select("node", spec.node(r, c).alias("nb"), "o.dir", "o.dr", "o.dc", "o.dx", *values)
    return out.filter("node <> nb")  # an axis of one cell doesn't meet itself


def neighbours(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8, values: list[str] | None = None) -> DataFrame:
    """Edges with the values of both ends (suffix _nb for the neighbour). No-data nodes have no neighbours.

    A value travels once to each neighbour: the join is on the computed id, and the node's own values go along.
    """
    values = values if values is not None else [c for c in nodes.columns if c not in ("node", "r", "c")]
    if "bc" in nodes.columns:
        nodes = nodes.filter(B.can_create_link(F.col("bc")))
    there = nodes.select(F.col("node").alias("nb"), *[F.col(v).alias(f"{v}_nb") for v in values])
    return offsets(nodes, spec, around, values).join(there, "nb").select("node", "nb", "dir", "dr", "dc", "dx", *[f"{v}_nb" for v in values], *values)


def d4_neighbours(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return neighbours(nodes, spec, D4)


def one_neighbour(nodes: DataFrame, spec: GridSpec, direction: str) -> DataFrame:
    """node and its neighbour in one direction (null outside the grid)."""
    at = [o for o in D8 if DIRECTIONS[o[0]] == direction]
    return nodes.select("node").join(offsets(nodes, spec, at).select("node", "nb"), "node", "left")


def links(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """link, a, b, dir, dx, state of every undirected pair. State: 0 inverse (b gives to a), 1 normal, 5 invalid
    (a no-data end, or nobody may give or receive)."""
    pairs = offsets(nodes, spec, LINKS)
    order = F.when(F.col("dir") == 4, 0).when(F.col("dir") == 7, 1).when(F.col("dir") == 6, 2).otherwise(3)
    out = pairs.select((F.col("node") * 4 + order).alias("link"), F.col("node").alias("a"), F.col("nb").alias("b"), "dir", "dx")
    code = F.col("bc") if "bc" in nodes.columns else F.lit(B.FLOW)
    ends = nodes.select("node", F.col("z").alias("z"), code.alias("bc"))
    out = out.join(ends.selectExpr("node as a", "z as z_a", "bc as bc_a"), "a").join(ends.selectExpr("node as b", "z as z_b", "bc as bc_b"), "b")
    down = (F.col("z_a") > F.col("z_b")) & B.can_give(F.col("bc_a")) & B.can_receive(F.col("bc_b"))
    up = (F.col("z_b") >= F.col("z_a")) & B.can_give(F.col("bc_b")) & B.can_receive(F.col("bc_a"))
    return out.select("link", "a", "b", "dir", "dx", F.when(down, 1).when(up, 0).otherwise(5).cast("byte").alias("state"))


def links_of(link_table: DataFrame) -> DataFrame:
    """node, link, other, dx: each link seen from both ends."""
    return link_table.selectExpr("a as node", "link", "b as other", "dx").unionAll(link_table.selectExpr("b as node", "link", "a as other", "dx"))


def link_ends(link_table: DataFrame) -> DataFrame:
    """link, from, to of the valid links."""
    down = F.col("state").isin(1, 3)
    return link_table.filter("state <= 3").select("link", F.when(down, F.col("a")).otherwise(F.col("b")).alias("from"), F.when(down, F.col("b")).otherwise(F.col("a")).alias("to"))


def orthogonal(edges: DataFrame, spec: GridSpec) -> DataFrame:
    """The two cells beside each edge (node, dir): left and right of the way it points; null outside the grid."""
    out = edges.select("node", "dir", "dr", "dc")
    here = spec.with_rowcol(out)
    for name, s in (("left", 1), ("right", -1)):
        r, c = F.col("r") - s * F.col("dc"), F.col("c") + s * F.col("dr")
        if spec.periodic_ns:
            r = F.pmod(r, F.lit(spec.ny))
        if spec.periodic_ew:
            c = F.pmod(c, F.lit(spec.nx))
        here = here.withColumn(name, F.when(r.between(0, spec.ny - 1) & c.between(0, spec.nx - 1), spec.node(r, c)))
    return here.select("node", "dir", "left", "right")


def bit_code(edges: DataFrame, out: str = "bits") -> DataFrame:
    """A byte of directions for each node: bit d is set where an edge in direction d is present."""
    return edges.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1, dir)")).cast("int").alias(out))


def neighbours_of_bits(codes: DataFrame, spec: GridSpec, bits: str = "bits") -> DataFrame:
    """The edges that a byte of directions stands for."""
    return offsets(codes, spec).join(codes.select("node", bits), "node").filter(F.expr(f"({bits} & shiftleft(1, dir)) <> 0")).drop(bits)


def extreme_neighbour(nodes: DataFrame, spec: GridSpec, value: str = "z", highest: bool = False) -> DataFrame:
    """node, nb, value of the highest or lowest neighbour; ties go to the smallest id."""
    e = neighbours(nodes, spec, values=[value])
    key = F.struct((-F.col(f"{value}_nb") if highest else F.col(f"{value}_nb")).alias("k"), F.col("nb"))
    best = e.groupBy("node").agg(F.min(key).alias("b"))
    return best.select("node", "b.nb", (-F.col("b.k") if highest else F.col("b.k")).alias(value))


def neighbourhood_stats(nodes: DataFrame, spec: GridSpec, value: str = "z") -> DataFrame:
    """node, n, mean, least, most, deviation (population) of the neighbours' values."""
    v = F.col(f"{value}_nb")
    return neighbours(nodes, spec, values=[value]).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("deviation")
    )


def pair_by_angle(edges: DataFrame, theta: Column) -> DataFrame:
    """The two neighbours of a node between which an angle (radians, from east, counter-clockwise) points, with
    shares that fall linearly with the angle between."""
    sector = F.floor(F.pmod(theta, F.lit(6.283185307179586)) / F.lit(0.7853981633974483))
    part = F.pmod(theta, F.lit(6.283185307179586)) / F.lit(0.7853981633974483) - sector
    ring = F.array(*[F.lit(d) for d in (4, 2, 1, 0, 3, 5, 6, 7)])  # directions counter-clockwise from east
    first = F.get(ring, sector.cast("int") % 8)
    second = F.get(ring, (sector.cast("int") + 1) % 8)
    share = F.when(F.col("dir") == first, 1 - part).when(F.col("dir") == second, part)
    return edges.withColumn("share", share).filter("share is not null")


def effective_neighbours(nodes: DataFrame, spec: GridSpec, kind: str = "node_type") -> DataFrame:
    """Neighbours by node type: a PERIODIC node wraps round the grid, a REFLECT node's missing neighbours are
    itself at distance 0, no-data nodes have none and are nobody's."""
    rows = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(spec.length(dr, dc)).alias("dx")) for d, dr, dc in D8])
    out = spec.with_rowcol(nodes.filter(B.type_is_active(F.col(kind))).select("node", kind)).select("node", "r", "c", kind, F.explode(rows).alias("o"))
    r, c = F.col("r") + F.col("o.dr"), F.col("c") + F.col("o.dc")
    inside = r.between(0, spec.ny - 1) & c.between(0, spec.nx - 1)
    wrapped = spec.node(F.pmod(r, F.lit(spec.ny)), F.pmod(c, F.lit(spec.nx)))
    nb = F.when(inside, spec.node(r, c)).when(F.col(kind) == B.PERIODIC, wrapped).when(F.col(kind) == B.REFLECT, F.col("node"))
    dx = F.when(inside | (F.col(kind) == B.PERIODIC), F.col("o.dx")).otherwise(F.lit(0.0))
    out = out.select("node", nb.alias("nb"), "o.dir", dx.alias("dx")).filter("nb is not null")
    return out.join(nodes.filter(B.type_is_active(F.col(kind))).select(F.col("node").alias("nb")), "nb", "left_semi")


def transfer_flow(fluxes: DataFrame, spec: GridSpec, kind: str = "node_type") -> DataFrame:
    """Where flux (node, dir, flux, node type) goes: into a neighbour (x 1), round the grid (x 1), back (x -1
    at a REFLECT node), or out of the model (target null, x 0 unless the node may let it out)."""
    step = F.create_map(*[F.lit(x) for d, dr, dc in D8 for x in (d, dr * 10 + dc)])
    here = spec.with_rowcol(fluxes)
    dr = F.round(F.element_at(step, F.col("dir")) / 10).cast("int")
    dc = F.element_at(step, F.col("dir")) - dr * 10
    r, c = F.col("r") + dr, F.col("c") + dc
    inside = r.between(0, spec.ny - 1) & c.between(0, spec.nx - 1)
    k = F.col(kind)
    target = F.when(inside, spec.node(r, c)).when(k == B.PERIODIC, spec.node(F.pmod(r, F.lit(spec.ny)), F.pmod(c, F.lit(spec.nx)))).when(k == B.REFLECT, F.col("node"))
    factor = F.when(inside | (k == B.PERIODIC), 1).when(k == B.REFLECT, -1).when(B.allows_outflow(k), 1).otherwise(0)
    return here.select("node", "dir", target.alias("target"), (F.col("flux") * factor).alias("flux"))
