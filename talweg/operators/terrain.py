"""Terrain derivatives, shading and smoothing by one neighbour join each."""

from __future__ import annotations

from math import cos, exp, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import GridSpec
from ..functions.vectors import noise
from .neighbours import neighbours, offsets


def _edges(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return neighbours(nodes.select("node", "z"), spec, values=["z"]).withColumn("dz", F.col("z_nb") - F.col("z"))


def _fill(nodes: DataFrame, got: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    return nodes.select("node").join(got, "node", "left").select("node", F.coalesce(column, F.lit(default)).alias(column))


def slope(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, slope: the steepest slope to a neighbour, up or down, in degrees."""
    got = _edges(nodes, spec).groupBy("node").agg(F.degrees(F.atan(F.max(F.abs("dz") / F.col("dx")))).alias("slope"))
    return _fill(nodes, got, "slope")


def aspect(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, aspect: degrees of the direction of summed differences (diagonals by 0.707), -1 where they cancel."""
    weight = F.when((F.col("dr") != 0) & (F.col("dc") != 0), 0.707).otherwise(1.0)
    e = _edges(nodes, spec)
    s = e.groupBy("node").agg(F.sum(F.col("dz") * F.col("dc") * weight).alias("sx"), F.sum(F.col("dz") * F.col("dr") * weight).alias("sy"))
    angle = F.degrees(F.atan2("sy", -F.col("sx")))
    got = s.select("node", F.when((F.col("sx") == 0) & (F.col("sy") == 0), -1.0).otherwise(F.when(angle < 0, angle + 360).otherwise(angle)).alias("aspect"))
    return _fill(nodes, got, "aspect", -1.0)


def roughness(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, roughness: root mean square difference to the neighbours."""
    return _fill(nodes, _edges(nodes, spec).groupBy("node").agg(F.sqrt(F.avg(F.col("dz") * F.col("dz"))).alias("roughness")), "roughness")


def curvature(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, curvature: mean of difference by squared distance."""
    return _fill(nodes, _edges(nodes, spec).groupBy("node").agg(F.avg(F.col("dz") / (F.col("dx") * F.col("dx"))).alias("curvature")), "curvature")


def exposure(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, exposure: how far a node stands above the mean of its neighbours, 0 if below."""
    return _fill(nodes, _edges(nodes, spec).groupBy("node").agg(F.greatest(F.lit(0.0), -F.avg("dz")).alias("exposure")), "exposure")


def shelter(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, shelter: the sum of slopes up to higher neighbours by the number of neighbours."""
    up = F.sum(F.when(F.col("dz") > 0, F.col("dz") / F.col("dx")).otherwise(0.0))
    return _fill(nodes, _edges(nodes, spec).groupBy("node").agg((up / F.count(F.lit(1))).alias("shelter")), "shelter")


def drainage_density(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, density: the sum of downhill slopes by the squared number of lower neighbours."""
    e = _edges(nodes, spec).filter("dz < 0")
    return _fill(nodes, e.groupBy("node").agg((F.sum(-F.col("dz") / F.col("dx")) * F.count(F.lit(1)) * F.count(F.lit(1))).alias("density")), "density")


def erosion_pattern(nodes: DataFrame, spec: GridSpec, intensity: float = 1.0, seed: int = 0) -> DataFrame:
    """node, erosion: (mean slope + share of higher neighbours) x intensity x (a half to one, seeded)."""
    e = _edges(nodes, spec).groupBy("node").agg((F.avg(F.abs("dz") / F.col("dx")) + F.avg((F.col("dz") > 0).cast("double"))).alias("_m"))
    return _fill(nodes, e.select("node", (F.col("_m") * intensity * (0.5 + 0.5 * noise(seed, F.col("node")))).alias("erosion")), "erosion")


def window3(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, z and z0 to z7 (null outside the grid): the 3 x 3 window in one row, by one join and one aggregate."""
    e = _edges(nodes, spec)
    w = e.groupBy("node").agg(*[F.max(F.when(F.col("dir") == d, F.col("z_nb"))).alias(f"z{d}") for d in range(8)])
    return nodes.join(w, "node", "left")


def hillshade(nodes: DataFrame, spec: GridSpec, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.0) -> DataFrame:
    """node, shade (0 to 1) from Horn's gradient over the 3 x 3 window; 0 where it isn't complete, on no data, and
    where flow may leave."""
    w = window3(nodes, spec)
    gx = ((F.col("z2") + 2 * F.col("z4") + F.col("z7")) - (F.col("z0") + 2 * F.col("z3") + F.col("z5"))) / (8 * spec.dx) * exaggeration
    gy = ((F.col("z5") + 2 * F.col("z6") + F.col("z7")) - (F.col("z0") + 2 * F.col("z1") + F.col("z2"))) / (8 * spec.dy) * exaggeration
    zenith, sun = radians(90.0 - altitude), radians((360.0 - azimuth + 90.0) % 360.0)
    steep = F.atan(F.hypot(gx, gy))
    facing = F.atan2(gy, -gx)
    shade = F.greatest(F.lit(cos(zenith)) * F.cos(steep) + F.lit(sin(zenith)) * F.sin(steep) * F.cos(F.lit(sun) - facing), F.lit(0.0))
    if "bc" in nodes.columns:
        shade = F.when(B.is_no_data(F.col("bc")) | B.can_out(F.col("bc")), 0.0).otherwise(shade)
    return w.select("node", F.coalesce(shade, F.lit(0.0)).alias("shade"))


def multi_hillshade(nodes: DataFrame, spec: GridSpec, azimuths: tuple[float, ...] = (225.0, 270.0, 315.0, 360.0), altitude: float = 45.0) -> DataFrame:
    """node, shade: the mean of shades from several azimuths."""
    out = None
    for k, a in enumerate(azimuths):
        one = hillshade(nodes, spec, a, altitude).withColumnRenamed("shade", f"s{k}")
        out = one if out is None else out.join(one, "node")
    return out.select("node", (sum(F.col(f"s{k}") for k in range(len(azimuths))) / len(azimuths)).alias("shade"))


def cast_shadow(nodes: DataFrame, spec: GridSpec, direction: str = "right", slope: float = 1.0) -> DataFrame:
    """node, shadow: whether a higher cell behind it along a row or diagonal shades a node, with light that falls
    ``slope`` by unit of length towards ``direction`` (right, bottomright or bottomleft): a running maximum along each ray."""
    rc = spec.with_rowcol(nodes.select("node", "z"))
    ray, step = {"right": (F.col("r"), spec.dx), "bottomright": (F.col("c") - F.col("r"), spec.dxy), "bottomleft": (F.col("c") + F.col("r"), spec.dxy)}[direction]
    at = F.col("c") if direction == "right" else F.col("r")
    rays = rc.withColumn("ray", ray).withColumn("at", at).withColumn("top", F.col("z") + at * (step * slope))
    return rays.selectExpr("node", "coalesce(max(top) over (partition by ray order by at rows between unbounded preceding and 1 preceding) > top, false) as shadow")


def blur(nodes: DataFrame, spec: GridSpec, radius: int, value: str = "z", gaussian: bool = True) -> DataFrame:
    """node, value: a Gaussian (standard deviation of half the radius) or box mean over rows, then columns; the
    window is cut at the grid's edge. Rows, then columns, are grouped by a neighbour id along one axis."""
    sigma = max(radius / 2.0, 1e-9)
    out = nodes.select("node", F.col(value).cast("double").alias("v"))
    for axis in (0, 1):
        line = [(k, *((0, k) if axis == 0 else (k, 0))) for k in range(-radius, radius + 1) if k]
        e = offsets(out, spec, line).join(out.select(F.col("node").alias("nb"), "v"), "nb")
        k = F.abs(F.col("dir"))
        w = F.exp(-(k * k) / F.lit(2.0 * sigma * sigma)) if gaussian else F.lit(1.0)
        s = e.groupBy("node").agg(F.sum(F.col("v") * w).alias("s"), F.sum(w).alias("w"))
        out = out.join(s, "node", "left").select("node", ((F.col("v") + F.coalesce("s", F.lit(0.0))) / (1 + F.coalesce("w", F.lit(0.0)))).alias("v"))
    return out.select("node", F.col("v").alias(value))


def terrain_class(slopes: DataFrame, flat: float = 5.0, steep: float = 30.0) -> DataFrame:
    return slopes.select("node", F.when(F.col("slope") < flat, "flat").when(F.col("slope") < steep, "slope").otherwise("cliff").alias("terrain"))


def diffuse(nodes: DataFrame, spec: GridSpec, kappa: float, dt: float, value: str = "z") -> DataFrame:
    """node, value after one explicit step of linear diffusion over the four sides."""
    from ..functions.grid import D4

    e = neighbours(nodes.select("node", F.col(value).cast("double").alias("z")), spec, D4, ["z"])
    flow = e.groupBy("node").agg(F.sum((F.col("z_nb") - F.col("z")) / (F.col("dx") * F.col("dx"))).alias("_l"))
    return nodes.select("node", value).join(flow, "node", "left").select("node", (F.col(value) + kappa * dt * F.coalesce("_l", F.lit(0.0))).alias(value))


def gaussian_weight(distance: float, sigma: float) -> float:
    return exp(-(distance**2) / (2 * sigma**2))


def bands(value: Column, thresholds: list[float]) -> Column:
    """The number of the first threshold that a value doesn't exceed; their count if there is none."""
    out = F.lit(len(thresholds))
    for k in range(len(thresholds) - 1, -1, -1):
        out = F.when(value <= thresholds[k], F.lit(k)).otherwise(out)
    return out.cast("long")
