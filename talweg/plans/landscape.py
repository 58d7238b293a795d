"""Landscape evolution: steady stream power, implicit incision, hillslopes, uplift, grid refinement, strata.

A step is a plan over tables: fill, flow directions, area, then a law. Every step ends in a table of its own.
Laws are columns or functions of columns; a parameter is a number or a column of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import GridSpec
from ..functions.vectors import noise
from ..operators.accumulate import accumulate_mfd, accumulate_sfd, as_edges
from ..operators.depressions import fill
from ..operators.flow import downhill, exponent_weights, steepest
from ..operators.iterate import level_loop, levels, to_root
from ..operators.neighbours import neighbours
from ..scratch import cut


def _lit(v: float | str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))


@dataclass(frozen=True)
class StreamPower:
    k: float = 1e-5
    m: float = 0.45
    n: float = 1.0
    uplift: float = 1e-3


def drained(nodes: DataFrame, spec: GridSpec, step: float = 1e-5) -> DataFrame:
    """nodes with z filled, and raised by ``step`` for each cell of lake crossed, so that every node has a way out:
    among equal neighbours the nearer to the spill is lower by a seeded order of nodes."""
    filled = fill(nodes, spec).select("node", F.col("filled").alias("z"), (F.col("filled") > F.col("z")).alias("_wet"))
    from ..operators.iterate import relax

    e = neighbours(filled, spec, values=["z", "_wet"]).filter("_wet_nb and z_nb >= z").select("node", "nb")
    lower = neighbours(filled, spec, values=["z", "_wet"]).filter("z_nb < z").select("node").distinct()
    start = filled.filter("not _wet").select("node").unionAll(lower).distinct().withColumn("value", F.lit(0.0))
    hops = relax(e.join(filled.select(F.col("node").alias("nb"), F.col("_wet").alias("w")), "nb").select("node", "nb"), start, F.col("value") + 1)
    out = filled.join(hops, "node", "left").select("node", (F.col("z") + F.when(F.col("_wet"), step * F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("z"))
    return cut(nodes.drop("z").join(out, "node"))


def steady_stream_power(nodes: DataFrame, spec: GridSpec, law: StreamPower = StreamPower(), rounds: int = 3) -> DataFrame:
    """nodes with z = z_rec + dx (U/K)^(1/n) A^(-m/n), repeated: directions change with the surface.

    z is a path sum down to the outlet, so a round is a fill, one neighbour join and two rounds of pointer doubling."""
    for _ in range(rounds):
        nodes = drained(nodes, spec)
        sfd = cut(steepest(nodes, spec))
        area = accumulate_sfd(sfd, constant=spec.cell_area)
        s = sfd.join(area, "node").withColumn("_w", F.col("dx") * (law.uplift / law.k) ** (1 / law.n) * F.pow("value", F.lit(-law.m / law.n)))
        base = to_root(s, F.col("_w")).select("node", "root", "length")
        z0 = nodes.select(F.col("node").alias("root"), F.col("z").alias("z0"))
        nodes = cut(nodes.drop("z").join(base.join(z0, "root").select("node", (F.col("z0") + F.col("length")).alias("z")), "node"))
    return nodes


def implicit_incision(nodes: DataFrame, sfd: DataFrame, area: DataFrame, dt: float, law: StreamPower = StreamPower(), newton: int = 6) -> DataFrame:
    """node, value: elevation after one implicit step of stream-power incision, solved from the outlets up.

    z' = z - dt K A^m ((z' - z'_rec)/dx)^n by a fixed number of Newton iterations as nested columns."""
    e = as_edges(sfd).join(area.withColumnRenamed("value", "area"), "node").join(nodes.select("node", F.col("z").cast("double").alias("z0")), "node")
    e = cut(e)
    level = levels(e, nodes)
    k = F.lit(law.k * dt) * F.pow("area", F.lit(law.m)) / F.pow("dx", F.lit(law.n))
    z = F.col("z0")
    for _ in range(newton):
        drop = F.greatest(z - F.col("value"), F.lit(1e-12))
        f = z - F.col("z0") + k * F.pow(drop, F.lit(law.n))
        z = z - f / (1 + k * law.n * F.pow(drop, F.lit(law.n - 1)))
    start = nodes.select("node", F.col("z").cast("double").alias("value"))
    return level_loop(e, start, level, F.greatest(z, F.col("value")), F.max, lambda a, b: F.least(a, b), downstream=False)


def uplifted(nodes: DataFrame, rate: float | str | Column, dt: float) -> DataFrame:
    """nodes raised where flow may not leave; block uplift by a number, a field by a column."""
    fixed = B.can_out(F.col("bc")) if "bc" in nodes.columns else F.lit(False)
    return nodes.withColumn("z", F.when(fixed, F.col("z")).otherwise(F.col("z") + _lit(rate) * dt))


def hillslope_fluxes(nodes: DataFrame, spec: GridSpec, kappa: float = 1e-3, critical: float = 0.6, mode: str = "full", longdep: float = 1.0) -> DataFrame:
    """node, erosion, deposition rates of slope-limited hillslope transport over single flow (Carretier and others, 2016).

    Below the critical slope erosion is kappa S and deposition Qs / L with L = area / (1 - (S/Sc)^2), no more than
    Qs / area; above it a node is cut back to Sc. Modes: full, no_critical (L = area), deposition_only, long (L x longdep).
    """
    e = cut(steepest(nodes, spec))
    level = levels(as_edges(e), nodes)
    ratio = F.col("slope") / critical
    length = F.lit(spec.cell_area) if mode == "no_critical" else F.lit(spec.cell_area) / F.greatest(1 - ratio * ratio, F.lit(1e-6))
    if mode == "long":
        length = length * longdep
    steep = F.lit(False) if mode == "no_critical" else F.col("slope") >= critical
    eroded = F.lit(0.0) if mode == "deposition_only" else F.when(steep, (F.col("slope") - critical) * F.col("dx")).otherwise(kappa * F.col("slope"))
    share = F.when(steep, 0.0).otherwise(F.least(1 / length, F.lit(1.0 / spec.cell_area)))  # of the flux, by unit of area
    own = cut(e.select("node", "dx", "slope", eroded.alias("erosion"), share.alias("share")))
    edges = as_edges(e).join(own.select("node", "erosion", "share"), "node")
    start = nodes.select("node", F.lit(0.0).alias("value"))
    send = F.col("value") * (1 - F.col("share") * spec.cell_area) + F.col("erosion") * spec.cell_area
    qs = level_loop(edges, start, level, send, F.sum, lambda a, b: a + b)
    return qs.join(own, "node").select("node", "erosion", (F.col("value") * F.col("share")).alias("deposition"))


def davy_lague(nodes: DataFrame, spec: GridSpec, k: float = 1e-5, m: float = 0.45, n: float = 1.0, settling: float = 1.0, rain: float = 1.0, exponent: float = 1.0) -> DataFrame:
    """node, erosion, deposition of a river law over multiple flow (Davy and Lague, 2009): erosion K Q^m S^n,
    deposition settling * Qs / Q."""
    e = cut(exponent_weights(downhill(nodes, spec), exponent))
    level = levels(e, nodes)
    q = accumulate_mfd(e, nodes, constant=rain * spec.cell_area, level=level).withColumnRenamed("value", "q")
    s = e.groupBy("node").agg(F.max("slope").alias("slope"))
    own = cut(nodes.select("node").join(s, "node", "left").join(q, "node").select("node", (F.lit(k) * F.pow("q", F.lit(m)) * F.pow(F.coalesce("slope", F.lit(0.0)), F.lit(n))).alias("erosion"), F.least(F.lit(settling) / F.col("q"), F.lit(1.0 / spec.cell_area)).alias("share")))
    edges = e.join(own, "node")
    send = (F.col("value") * (1 - F.col("share") * spec.cell_area) + F.col("erosion") * spec.cell_area) * F.col("weight")
    qs = level_loop(edges, nodes.select("node", F.lit(0.0).alias("value")), level, send, F.sum, lambda a, b: a + b)
    return qs.join(own, "node").select("node", "erosion", (F.col("value") * F.col("share")).alias("deposition"))


def moved(nodes: DataFrame, fluxes: DataFrame, dt: float) -> DataFrame:
    """nodes with z changed by deposition less erosion, but where flow may leave."""
    fixed = B.can_out(F.col("bc")) if "bc" in nodes.columns else F.lit(False)
    out = nodes.join(fluxes, "node", "left")
    dz = (F.coalesce("deposition", F.lit(0.0)) - F.coalesce("erosion", F.lit(0.0))) * dt
    return out.withColumn("z", F.when(fixed, F.col("z")).otherwise(F.col("z") + dz)).drop("erosion", "deposition")


def evolve(nodes: DataFrame, spec: GridSpec, laws: list, dt: float, steps: int, uplift: float | str = 0.0) -> DataFrame:
    """Run pluggable laws (functions of nodes and grid that give erosion and deposition) for some steps."""
    for _ in range(steps):
        nodes = cut(uplifted(nodes, uplift, dt))
        nodes = drained(nodes, spec)
        for law in laws:
            nodes = cut(moved(nodes, law(nodes, spec), dt))
    return nodes


def landslides(nodes: DataFrame, spec: GridSpec, cohesion: float, friction: float, density: float = 2700.0, gravity: float = 9.81, seed: int = 0) -> DataFrame:
    """node, fails, height: seeded failures where the drop to the receiver is likely beyond Culmann's height."""
    from math import cos, radians, sin, tan

    e = steepest(nodes, spec)
    beta = F.atan("slope")
    phi = radians(friction)
    hc = 4 * cohesion / (density * gravity) * F.sin(beta) * cos(phi) / F.greatest(1 - F.cos(beta - phi), F.lit(1e-9))
    drop = F.col("slope") * F.col("dx")
    fails = (F.col("slope") > tan(phi)) & (drop / hc > noise(seed, F.col("node")))
    return e.select("node", fails.alias("fails"), F.when(fails, drop - F.col("dx") * tan(phi)).otherwise(0.0).alias("height")) if sin(phi) >= 0 else e


def marine(nodes: DataFrame, spec: GridSpec, sea: float, kappa: float, dt: float) -> DataFrame:
    """nodes after a step of diffusion below sea level only."""
    from ..operators.terrain import diffuse

    new = diffuse(nodes, spec, kappa, dt).withColumnRenamed("z", "_z")
    return nodes.join(new, "node").withColumn("z", F.when(F.col("z") < sea, F.least(F.col("_z"), F.lit(sea))).otherwise(F.col("z"))).drop("_z")


def refined(nodes: DataFrame, spec: GridSpec, amplitude: float = 0.0, seed: int = 0, smooth: bool = False) -> tuple[DataFrame, GridSpec]:
    """Twice the rows and columns: each cell becomes four, with seeded noise and, if asked, a 3 x 3 mean."""
    from ..operators.terrain import blur

    fine = GridSpec(2 * spec.nx, 2 * spec.ny, spec.dx / 2, spec.dy / 2, spec.xmin, spec.ymin, spec.periodic_ew, spec.periodic_ns)
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    out = spec.with_rowcol(nodes.select("node", "z")).select("r", "c", "z", F.explode(four).alias("o"))
    node = fine.node(2 * F.col("r") + F.col("o.a"), 2 * F.col("c") + F.col("o.b"))
    out = out.select(node.alias("node"), F.col("z").cast("double").alias("z"))
    out = out.withColumn("z", F.col("z") + amplitude * noise(seed, F.col("node")))
    return (blur(out, fine, 1, gaussian=False) if smooth else out), fine


# strata: an array of layers, the last one at the surface


def deposit(nodes: DataFrame, thickness: Column, prop: Column, cell: float, strata: str = "strata") -> DataFrame:
    """Add sediment: it fills the topmost layer to ``cell`` and opens new ones; a layer's property is the mean by thickness."""
    layer = F.struct(thickness.cast("double").alias("thickness"), prop.cast("double").alias("prop"))
    top = F.element_at(F.col(strata), -1)
    mixed = F.struct((top["thickness"] + thickness).cast("double").alias("thickness"), ((top["thickness"] * top["prop"] + thickness * prop) / (top["thickness"] + thickness)).cast("double").alias("prop"))
    body = F.slice(strata, 1, F.greatest(F.size(strata) - 1, F.lit(0)))
    fits = (F.size(strata) > 0) & (F.when(F.size(strata) > 0, F.try_element_at(F.col(strata), F.lit(-1))["thickness"]) + thickness <= cell)
    return nodes.withColumn(strata, F.when(thickness <= 0, F.col(strata)).when(fits, F.concat(body, F.array(mixed))).otherwise(F.concat(strata, F.array(layer))))


def strip(nodes: DataFrame, thickness: Column, strata: str = "strata") -> DataFrame:
    """Take sediment from the top: whole layers, and a part of the one below them."""
    state = F.struct(thickness.cast("double").alias("left"), F.slice(strata, 1, 0).alias("kept"))

    def take(s: Column, layer: Column) -> Column:
        rest = F.greatest(layer["thickness"] - s["left"], F.lit(0.0))
        part = F.struct(rest.alias("thickness"), layer["prop"].alias("prop"))
        return F.struct(F.greatest(s["left"] - layer["thickness"], F.lit(0.0)).alias("left"), F.when(rest > 0, F.concat(F.array(part), s["kept"])).otherwise(s["kept"]).alias("kept"))

    return nodes.withColumn(strata, F.aggregate(F.reverse(strata), state, take)["kept"])


def aged(nodes: DataFrame, dt: float, strata: str = "strata") -> DataFrame:
    """Layers whose property is an age, older by dt."""
    return nodes.withColumn(strata, F.transform(strata, lambda s: F.struct(s["thickness"].alias("thickness"), (s["prop"] + dt).alias("prop"))))


def core(nodes: DataFrame, node: int, strata: str = "strata") -> DataFrame:
    """depth (of a layer's top), thickness, prop of the layers below one node, from the surface down."""
    rows = nodes.filter(F.col("node") == node).select(F.posexplode(F.reverse(strata)).alias("k", "s"))
    return rows.selectExpr("k", "coalesce(sum(s.thickness) over (order by k rows between unbounded preceding and 1 preceding), 0d) as depth", "s.thickness", "s.prop")


def erodibility_bands(values: DataFrame, edges: list[float], ks: list[float]) -> DataFrame:
    """node, k by band of a value (elevation or chi): ks has one more entry than edges."""
    from ..operators.terrain import bands

    return values.select("node", F.get(F.array(*[F.lit(float(k)) for k in ks]), bands(F.col("value"), edges).cast("int")).alias("k"))
