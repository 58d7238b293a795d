"""Sparse voxels: rows (x, y, z, value); an absent row has the default value."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import stencils
from .components import components
from .parts import least

#: Side of blocks that are one task's.
BLOCK = 48
XYZ = ["x", "y", "z"]


def ring(connectivity: int = 6) -> list[tuple[int, int, int]]:
    """Offsets of 6 (faces), 18 (and edges) or 26 (and corners) neighbours."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) <= most]


def _around(vox: DataFrame, offsets: list[tuple[int, int, int]], prefix: str = "n") -> DataFrame:
    o = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offsets])
    out = vox.withColumn("_o", F.explode(o))
    return out.select(*vox.columns, *[(F.col(k) + F.col(f"_o.{d}")).alias(f"{prefix}{k}") for k, d in zip(XYZ, "abc")])


def neighbours(vox: DataFrame, connectivity: int = 6, existing: bool = True) -> DataFrame:
    """Voxels with the coordinates and (if existing) values of their neighbours."""
    e = _around(vox, ring(connectivity))
    # places take little room in files and much in memory: a merge join, as the other one would send them through the driver
    there = vox.select(*[F.col(k).alias(f"n{k}") for k in XYZ], F.col("value").alias("value_n")).hint("merge")
    return e.join(there, ["nx", "ny", "nz"], "inner" if existing else "left")


def neighbour_count(vox: DataFrame, connectivity: int = 6) -> DataFrame:
    return stencils.counts(vox, ring(connectivity))


def put(vox: DataFrame, more: DataFrame) -> DataFrame:
    """Set values: rows of ``more`` replace those at the same place."""
    return vox.join(more.select(*XYZ), XYZ, "left_anti").select(*XYZ, "value").unionAll(more.select(*XYZ, "value"))


def remove(vox: DataFrame, places: DataFrame) -> DataFrame:
    return vox.join(places.select(*XYZ), XYZ, "left_anti")


def box(spark, lo: tuple[int, int, int], hi: tuple[int, int, int], value: float) -> DataFrame:
    """All voxels of a box, ends included."""
    out = spark.range(lo[0], hi[0] + 1).select(F.col("id").alias("x"))
    for k, name in ((1, "y"), (2, "z")):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(lo[k]).cast("long"), F.lit(hi[k]).cast("long"))))
    return out.withColumn("value", F.lit(float(value)))


def sphere(spark, centre: tuple[int, int, int], radius: float, value: float) -> DataFrame:
    k = int(radius)
    b = box(spark, tuple(c - k for c in centre), tuple(c + k for c in centre), value)
    return b.filter(in_sphere(centre, radius))


def in_box(lo: tuple[int, int, int], hi: tuple[int, int, int]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).between(lo[i], hi[i]) for i, k in enumerate(XYZ)])


def in_sphere(centre: tuple[float, float, float], radius: float) -> Column:
    return sum((F.col(k) - centre[i]) * (F.col(k) - centre[i]) for i, k in enumerate(XYZ)) <= radius * radius


def translate(vox: DataFrame, d: tuple[int, int, int]) -> DataFrame:
    return vox.select(*[(F.col(k) + d[i]).alias(k) for i, k in enumerate(XYZ)], *[c for c in vox.columns if c not in XYZ])


def scale(vox: DataFrame, k: int) -> DataFrame:
    return vox.select(*[(F.col(c) * k).alias(c) for c in XYZ], *[c for c in vox.columns if c not in XYZ])


def mirror(vox: DataFrame, axis: str, at: int = 0) -> DataFrame:
    return vox.withColumn(axis, F.lit(2 * at) - F.col(axis))


def statistics(vox: DataFrame) -> DataFrame:
    """One row: count, bounding box, least, largest, mean and sum of values."""
    return vox.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in XYZ for f, n in ((F.min, "min"), (F.max, "max"))], F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean"), F.sum("value").alias("v_sum"))


def slice_at(vox: DataFrame, axis: str, at: int) -> DataFrame:
    """A plane: the two other coordinates and the value."""
    return vox.filter(F.col(axis) == at).select(*[c for c in XYZ if c != axis], "value")


def plane(vox: DataFrame, normal: tuple[float, float, float], offset: float, thickness: float = 0.5) -> DataFrame:
    size = float(np.linalg.norm(normal))
    d = (sum(F.col(k) * normal[i] for i, k in enumerate(XYZ)) - offset) / size
    return vox.filter(F.abs(d) <= thickness)


def dense(vox: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int], default: float = 0.0) -> DataFrame:
    return box(vox.sparkSession, lo, hi, 0).drop("value").join(vox, XYZ, "left").select(*XYZ, F.coalesce("value", F.lit(default)).alias("value"))


def flood(vox: DataFrame, seeds: DataFrame, connectivity: int = 6, where: Column | None = None) -> DataFrame:
    """x, y, z, step of existing voxels (that meet a condition) reached from the seeds, by blocks that are solved as a whole."""
    ok = cut((vox if where is None else vox.filter(where)).select(*[F.col(k).cast("long").alias(k) for k in XYZ]).distinct())
    box = ok.agg(*[f(k) for k in XYZ for f in (F.min, F.max)]).first()
    if box[0] is None:
        return ok.withColumn("step", F.lit(0))
    low, size = box[::2], [box[2 * k + 1] - box[2 * k] + 1 for k in range(3)]
    blocks = [-(-s // BLOCK) for s in size]

    def number(p: list[Column]) -> Column:
        x, y, z = [v - lo for v, lo in zip(p, low)]
        return ((x * size[1] + y) * size[2] + z).cast("long")

    def place(n: Column) -> list[Column]:
        return [F.floor(n / (size[1] * size[2])), F.floor(n / size[2]) % size[1], n % size[2]]

    def block(n: Column) -> Column:
        x, y, z = [F.floor(v / BLOCK) for v in place(n)]
        return (x * blocks[1] + y) * blocks[2] + z

    here, there = [F.col(k) for k in XYZ], [F.col(f"n{k}") for k in XYZ]
    inside = reduce(lambda a, b: a & b, [v.between(lo, lo + s - 1) for v, lo, s in zip(there, low, size)])
    e = _around(ok, ring(connectivity)).filter(inside).select(number(here).alias("node"), number(there).alias("nb"))
    e = e.join(ok.select(number(here).alias("nb")).hint("merge"), "nb")
    start = ok.join(seeds.select(*[F.col(k).cast("long").alias(k) for k in XYZ]).distinct(), XYZ, "left_semi")
    found = least(e, start.select(number(here).alias("node"), F.lit(0.0).alias("value")), block)
    return found.select(*[(v + lo).cast("long").alias(k) for k, v, lo in zip(XYZ, place(F.col("node")), low)], F.col("value").cast("int").alias("step"))


def fill_value(vox: DataFrame, seeds: DataFrame, value: float, connectivity: int = 6, where: Column | None = None) -> DataFrame:
    """Flood from the seeds and set a value."""
    hit = flood(vox, seeds, connectivity, where).select(*XYZ).withColumn("_h", F.lit(True))
    return vox.join(hit, XYZ, "left").select(*XYZ, F.when(F.col("_h").isNotNull(), F.lit(float(value))).otherwise(F.col("value")).alias("value"))


def label(vox: DataFrame, connectivity: int = 6) -> DataFrame:
    """x, y, z, component: voxels are numbered by place, so a component is named by its first voxel."""
    lo = vox.agg(*[F.min(k).alias(k) for k in XYZ], *[(F.max(k) - F.min(k) + 1).alias(f"s{k}") for k in XYZ]).first()
    if lo["x"] is None:
        return vox.select(*XYZ, F.lit(None).cast("long").alias("component"))

    def key(p: str = "") -> Column:
        return ((F.col(f"{p}x") - lo["x"]) * lo["sy"] + (F.col(f"{p}y") - lo["y"])) * lo["sz"] + (F.col(f"{p}z") - lo["z"])

    e = neighbours(vox.select(*XYZ, "value"), connectivity).select(key().alias("u"), key("n").alias("v"))
    c = components(e)
    own = vox.select(*XYZ, key().cast("long").alias("node"))
    return own.join(c, "node", "left").select(*XYZ, F.coalesce("component", "node").cast("long").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def largest_component(labels: DataFrame) -> DataFrame:
    """The voxels of the largest component; ties go to the first."""
    top = component_sizes(labels).orderBy(F.col("n").desc(), "component").limit(1).select("component")
    return labels.join(F.broadcast(top), "component", "left_semi")


def sized_components(labels: DataFrame, least: int) -> DataFrame:
    return labels.join(component_sizes(labels).filter(F.col("n") >= least).select("component"), "component", "left_semi")


def erode(vox: DataFrame, connectivity: int = 6, rounds: int = 1, kernel: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Voxels whose neighbours (by connectivity or a kernel of offsets) all exist."""
    offs = kernel if kernel is not None else ring(connectivity)
    for _ in range(rounds):
        if vox.columns == [*XYZ, "value"]:
            vox = cut(stencils.full(vox, offs))
        else:
            vox = cut(vox.join(stencils.counts(vox, offs).filter(F.col("n") == len(offs)).select(*XYZ), XYZ, "left_semi"))
    return vox


def dilate(vox: DataFrame, value: float, connectivity: int = 6, rounds: int = 1, kernel: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Voxels and their absent neighbours, which get a value."""
    offs = kernel if kernel is not None else ring(connectivity)
    for _ in range(rounds):
        vox = cut(stencils.grown(vox, offs, value))
    return vox


def opening(vox: DataFrame, value: float, connectivity: int = 6, rounds: int = 1) -> DataFrame:
    return dilate(erode(vox, connectivity, rounds), value, connectivity, rounds)


def closing(vox: DataFrame, value: float, connectivity: int = 6, rounds: int = 1) -> DataFrame:
    return erode(dilate(vox, value, connectivity, rounds), connectivity, rounds)


def surface(vox: DataFrame, connectivity: int = 6) -> DataFrame:
    return vox.join(neighbour_count(vox, connectivity).filter(F.col("n") < len(ring(connectivity))), XYZ, "left_semi")


def interior(vox: DataFrame, connectivity: int = 6) -> DataFrame:
    return vox.join(neighbour_count(vox, connectivity).filter(F.col("n") == len(ring(connectivity))), XYZ, "left_semi")


def distance_steps(vox: DataFrame, seeds: DataFrame, connectivity: int = 6) -> DataFrame:
    """Steps to the nearest seed through existing voxels (Manhattan with 6 neighbours)."""
    return flood(vox, seeds, connectivity)


def distance_to(vox: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """x, y, z, distance: Euclidean distance to the nearest seed within ``reach`` (null beyond): seeds are sent to
    the places around them, so the cost is bounded by seeds x reach^3 and nothing spreads without end."""
    ball = [(a, b, c) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) for c in range(-reach, reach + 1) if a * a + b * b + c * c <= reach * reach]
    near = _around(seeds.select(*XYZ).distinct(), ball)
    d = sum((F.col(f"n{k}") - F.col(k)) * (F.col(f"n{k}") - F.col(k)) for k in XYZ)
    best = near.groupBy("nx", "ny", "nz").agg(F.sqrt(F.min(d)).alias("distance")).select(*[F.col(f"n{k}").alias(k) for k in XYZ], "distance")
    return vox.select(*XYZ).join(best, XYZ, "left")


def gaussian(vox: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Values smoothed over existing neighbours within a cell, weights normalised."""
    return stencils.smoothed(vox, ring(26), sigma)


def bilateral(vox: DataFrame, sigma: float = 1.0, sigma_value: float = 1.0) -> DataFrame:
    """As gaussian(), with weights that also fall with the difference of values."""
    return stencils.smoothed(vox, ring(26), sigma, sigma_value)


def median(vox: DataFrame, connectivity: int = 26) -> DataFrame:
    return stencils.medians(vox, ring(connectivity))


def centroids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in XYZ])


def principal_axes(vox: DataFrame) -> list[tuple[float, tuple[float, float, float]]]:
    """Eigenvalues and axes of the coordinates' covariance, largest first: nine aggregates, solved on the driver."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    row = vox.agg(*[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).first()
    m = np.array([[row[min(a, b) + max(a, b)] or 0.0 for b in XYZ] for a in XYZ], float)
    values, vectors = np.linalg.eigh(m)
    return [(float(values[k]), tuple(float(v) for v in vectors[:, k])) for k in (2, 1, 0)]


def area_volume(vox: DataFrame) -> DataFrame:
    """One row: volume (voxels) and area (faces without a neighbour)."""
    return neighbour_count(vox).agg(F.count(F.lit(1)).alias("volume"), F.sum(6 - F.col("n")).alias("area"))


def grow(vox: DataFrame, seeds: DataFrame, tolerance: float, connectivity: int = 6) -> DataFrame:
    """Region growing: from each seed (x, y, z) through neighbours whose value is within ``tolerance`` of the mean of the seeds."""
    mean = vox.join(seeds.select(*XYZ), XYZ, "left_semi").agg(F.avg("value")).first()[0]
    return flood(vox, seeds, connectivity, F.abs(F.col("value") - F.lit(mean)) <= tolerance)


def watershed(vox: DataFrame, connectivity: int = 6) -> DataFrame:
    """x, y, z, basin: each voxel follows its lowest neighbour (ties by place) down to a minimum that names its basin."""
    e = neighbours(vox.select(*XYZ, "value"), connectivity).filter((F.col("value_n") < F.col("value")) | ((F.col("value_n") == F.col("value")) & (F.struct("nx", "ny", "nz") < F.struct(*XYZ))))
    low = e.groupBy(*XYZ).agg(F.min(F.struct("value_n", "nx", "ny", "nz")).alias("m"))
    down = F.struct(*[F.col(f"m.n{k}").alias(k) for k in XYZ])
    own = F.struct(*XYZ)
    at = vox.select(*XYZ).join(low, XYZ, "left").select(own.alias("p"), F.when(F.col("m").isNotNull(), down).otherwise(own).alias("to"))
    at = cut(at)
    while True:
        nxt = cut(at.join(at.select(F.col("p").alias("to"), F.col("to").alias("to2")), "to").select("p", F.col("to2").alias("to"), (F.col("to") != F.col("to2")).alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nxt.select("p.x", "p.y", "p.z", F.col("to").alias("basin"))
        at = nxt.drop("moved")


def skeleton(vox: DataFrame, connectivity: int = 6) -> DataFrame:
    """Morphological skeleton: what each erosion's opening loses, united (Lantuejoul's formula)."""
    out, level = None, 0
    left = cut(vox.select(*XYZ, "value"))
    while not left.isEmpty():
        opened = opening(left, 0.0, connectivity)
        part = left.join(opened.select(*XYZ), XYZ, "left_anti").select(*XYZ, F.lit(level).alias("level"))
        out = part if out is None else out.unionAll(part)
        left, level = erode(left, connectivity), level + 1
    return out if out is not None else vox.select(*XYZ, F.lit(0).alias("level")).limit(0)
