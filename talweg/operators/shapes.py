"""Objects of voxels and the measures of their shapes."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .voxels import XYZ, label

_OCTANT = [(a, b, c) for c in (0, 1) for b in (0, 1) for a in (0, 1)]


def corners(labels: DataFrame) -> DataFrame:
    """labels with ``mask``: bit a + 2b + 4c is set if there is a voxel at (x + a, y + b, z + c), a, b, c of 0 and 1.

    Each voxel tells the eight places that it is a corner for, and what a place is told meets in one grouping."""
    told = F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip((*o, 1 << i), "abcm")]) for i, o in enumerate(_OCTANT)])
    sent = labels.select(*XYZ, "component").distinct().withColumn("_o", F.explode(told))
    own = F.when(F.col("_o.m") == 1, F.col("component"))
    sent = sent.select(*[(F.col(k) - F.col(f"_o.{d}")).alias(k) for k, d in zip(XYZ, "abc")], F.col("_o.m").alias("m"), own.alias("own"))
    return sent.groupBy(*XYZ).agg(F.max("own").alias("component"), F.bit_or("m").alias("mask")).filter("component is not null")


def _has(*bits: int) -> Column:
    """1 if the mask has the voxel itself and all these corners."""
    want = 1 | sum(1 << b for b in bits)
    return (F.col("mask").bitwiseAND(F.lit(want)) == want).cast("long")


def _cells_sum(labels: DataFrame) -> DataFrame:
    """component, euler of closed cubes: corners less edges plus faces less cubes, each counted once in an object."""
    side = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    cells = labels.select("component", *[(2 * F.col(k) + 1).alias(k) for k in XYZ])
    for k in XYZ:
        cells = cells.withColumn("_d", F.explode(side)).select("component", *[(F.col(c) + F.col("_d")).alias(c) if c == k else F.col(c) for c in XYZ])
    odd = sum(F.pmod(F.col(k), F.lit(2)) for k in XYZ)
    return cells.distinct().groupBy("component").agg(F.sum(1 - 2 * F.pmod(odd, F.lit(2))).cast("long").alias("euler"))


def spreads(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """The eigenvalues of a symmetric matrix of three rows, largest first, in closed form."""
    q = (xx + yy + zz) / 3
    a, b, c = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, det / (2 * p * p * p)).otherwise(F.lit(0.0))
    phi = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3
    top, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + F.lit(2 * pi / 3))
    return [F.greatest(v, F.lit(0.0)) for v in (top, 3 * q - top - low, low)]


def objects(labels: DataFrame, connectivity: int = 6) -> DataFrame:
    """One row for each component of ``labels`` (x, y, z, component; repeated voxels count once).

    volume (voxels), area (faces without a neighbour), euler (pieces less tunnels plus cavities, for the connectivity, 6 or
    26, that the labels were made with), bounds, centroid, length1 to length3 (standard deviations along principal axes),
    elongation and flatness (1 - length2 / length1, 1 - length3 / length2; null where they divide by 0), compactness
    (area^1.5 / volume) and sphericity (1 for a ball). Empty labels give no rows.
    """
    if connectivity not in (6, 26):
        raise ValueError("the Euler number is for 6 or 26 neighbours")
    pairs = _has(1) + _has(2) + _has(4)
    squares = _has(1, 2, 3) + _has(1, 4, 5) + _has(2, 4, 6)
    bounds = [f(k).alias(f"{k}_{n}") for k in XYZ for f, n in ((F.min, "min"), (F.max, "max"))]
    moments = [F.covar_pop(a, b).alias(f"_{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]]
    out = corners(labels).groupBy("component").agg(
        F.count(F.lit(1)).alias("volume"), F.sum(6 - 2 * pairs).alias("area"), F.sum(1 - pairs + squares - _has(*range(1, 8))).alias("euler"),
        *bounds, *[F.avg(k).alias(k) for k in XYZ], *moments,
    )
    if connectivity == 26:
        out = out.drop("euler").join(_cells_sum(labels.select(*XYZ, "component").distinct()), "component")
    lengths = spreads(*[F.col(f"_{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")])
    out = out.select("component", "volume", "area", "euler", *[f"{k}_{n}" for k in XYZ for n in ("min", "max")], *XYZ, *[F.sqrt(v).alias(f"length{i}") for i, v in enumerate(lengths, 1)])
    area, volume = F.col("area").cast("double"), F.col("volume").cast("double")
    share = lambda a, b: F.when(F.col(b) > 0, 1 - F.col(a) / F.col(b))
    return out.select(
        "*", share("length2", "length1").alias("elongation"), share("length3", "length2").alias("flatness"),
        (F.pow(area, F.lit(1.5)) / volume).alias("compactness"), (F.lit(pi ** (1 / 3)) * F.pow(6 * volume, F.lit(2 / 3)) / area).alias("sphericity"),
    )


def segmented(vox: DataFrame, connectivity: int = 6, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The objects of voxels that meet a condition: their labels, and a row of measures for each."""
    labels = cut(label((vox if where is None else vox.filter(where)).select(*XYZ, "value"), connectivity))
    return labels, objects(labels, connectivity)
