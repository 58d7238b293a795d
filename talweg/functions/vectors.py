"""Plane vectors and simple statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Length and angle (radians, from the x axis)."""
    return F.hypot(x, y), F.atan2(y, x)


def cartesian(length: Column, angle: Column) -> tuple[Column, Column]:
    return length * F.cos(angle), length * F.sin(angle)


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """The vector of length 1; a null vector stays null."""
    size = F.hypot(x, y)
    return tuple(F.when(size > 0, v / size).otherwise(F.lit(0.0)) for v in (x, y))


def normal(x: Column, y: Column) -> tuple[Column, Column]:
    return -y, x


def cross(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x1 * y2 - y1 * x2


def dot(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x1 * x2 + y1 * y2


def curvature_radius(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Radius of the circle through three points; null if they are on a line."""
    a, b, c = F.hypot(x2 - x1, y2 - y1), F.hypot(x3 - x2, y3 - y2), F.hypot(x1 - x3, y1 - y3)
    area = F.abs(cross(x2 - x1, y2 - y1, x3 - x1, y3 - y1))
    return F.when(area > 0, a * b * c / (2 * area))


def normalised(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """A column on the range 0 to 1; a constant becomes 0. One aggregate row is sent to all tasks."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(out or column, share).drop("_lo", "_hi")


def noise(seed: int, key: Column) -> Column:
    """A number from 0 to 1 that a key and a seed decide: the same in every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)).cast("double") / float(1 << 53)
