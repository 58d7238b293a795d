"""Where surfaces come from and go to: arrays, .npy files, tables, noise."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.vectors import noise


def from_array(spark: SparkSession, values: np.ndarray, column: str = "z") -> DataFrame:
    """nodes of a flat or two-dimensional host array, row-major."""
    flat = np.asarray(values).ravel()
    return spark.createDataFrame(pd.DataFrame({"node": np.arange(len(flat), dtype=np.int64), column: flat}))


def to_array(nodes: DataFrame, spec: GridSpec, column: str = "z", missing: float = np.nan) -> np.ndarray:
    """A host array (ny, nx); it has to fit the driver, as arrays of this kind do."""
    got = nodes.select("node", F.col(column).cast("double").alias("v")).toPandas()
    out = np.full(spec.size, missing)
    out[got["node"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(spec.ny, spec.nx)


def read_npy(spark: SparkSession, path: str, column: str = "z") -> DataFrame:
    """nodes of one .npy file, read by Spark's own readers, so that any store will do."""
    import io

    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return from_array(spark, np.load(io.BytesIO(bytes(raw))), column)


def write_npy(nodes: DataFrame, spec: GridSpec, path: str, column: str = "z", flat: bool = False) -> None:
    out = to_array(nodes, spec, column)
    np.save(Path(path), out.ravel() if flat else out)


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, GridSpec]:
    """nodes and grid of an ASCII raster (header lines, then rows of numbers); no-data cells are left out."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    head = {r[0].split()[0].lower(): float(r[0].split()[1]) for r in lines.orderBy("at").limit(6).select("value").collect() if r[0] and r[0].split()[0][0].isalpha()}
    cell = head.get("cellsize", 1.0)
    spec = GridSpec(int(head["ncols"]), int(head["nrows"]), cell, cell, head.get("xllcorner", 0.0), head.get("yllcorner", 0.0))
    rows = lines.filter(~F.col("value").rlike("^\\s*[A-Za-z]") & (F.trim("value") != "")).selectExpr("row_number() over (order by at) - 1 as r", "split(trim(value), ' +') as v")
    nodes = rows.select("r", F.posexplode("v").alias("c", "z")).select((F.col("r") * spec.nx + F.col("c")).cast("long").alias("node"), F.col("z").cast("double").alias("z"))
    return nodes.filter(F.col("z") != head.get("nodata_value", -9999.0)), spec


def export_types(nodes: DataFrame, kind: str = "node_type") -> DataFrame:
    return nodes.select("node", F.col(kind).cast("byte").alias(kind))


def import_types(nodes: DataFrame, values: DataFrame, kind: str = "node_type") -> DataFrame:
    """nodes with types from a table (node, value); values outside 0 to 6 are an error."""
    if not values.filter(~F.col("value").between(0, 6)).isEmpty():
        raise ValueError("a node type is out of range")
    return nodes.drop(kind).join(values.select("node", F.col("value").cast("byte").alias(kind)), "node", "left")


def white_noise(spark: SparkSession, spec: GridSpec, seed: int = 0, base: float = 5.0) -> DataFrame:
    return spark.range(spec.size).select(F.col("id").alias("node"), (base + noise(seed, F.col("id"))).alias("z"))


def gradient_noise(x: np.ndarray, y: np.ndarray, seed: int, period: int | None = None) -> np.ndarray:
    """Perlin's gradient noise, about -1 to 1; corners get seeded gradients by hash, and ``period`` makes it tile."""
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)

    def corner(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = (i % period, j % period) if period else (i, j)
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed * 0x165667B19E3779F9 % (1 << 64))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        angle = (h >> np.uint64(40)).astype(float) * (2 * np.pi / (1 << 24))
        return np.cos(angle) * (x - i) + np.sin(angle) * (y - j)

    def fade(t: np.ndarray) -> np.ndarray:
        return t * t * t * (t * (6 * t - 15) + 10)

    got = [corner(x0 + di, y0 + dj) for di in (0, 1) for dj in (0, 1)]
    u, v = fade(x - x0), fade(y - y0)
    low, high = got[0] * (1 - u) + got[2] * u, got[1] * (1 - u) + got[3] * u
    return (low * (1 - v) + high * v) * 2**0.5


def noise_surface(spark: SparkSession, spec: GridSpec, frequency: float = 8.0, octaves: int = 4, persistence: float = 0.5, kind: str = "fractal", seed: int = 0, tile: bool = False) -> DataFrame:
    """nodes with z of summed octaves: fractal, turbulence (absolute values), billow (absolute, recentred) or ridged
    (one less the absolute, squared). Each batch of nodes is a numpy call; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node = pdf["id"].to_numpy()
            x, y = node % spec.nx / spec.nx, node // spec.nx / spec.ny
            z, weight, total = np.zeros(len(node)), 1.0, 0.0
            for k in range(octaves):
                f = frequency * 2**k
                v = gradient_noise(x * f, y * f, seed + k, int(f) if tile else None)
                v = {"fractal": v, "turbulence": np.abs(v), "billow": 2 * np.abs(v) - 1, "ridged": (1 - np.abs(v)) ** 2}[kind]
                z, total, weight = z + weight * v, total + weight, weight * persistence
            yield pd.DataFrame({"node": node, "z": z / total})

    return spark.range(spec.size).mapInPandas(run, "node long, z double")


def columns_of(events_rows: int) -> int:
    """Columns of the grid that the events table is laid out on. Fixed values for its three sizes."""
    return {1_000: 40, 10_000: 100, 100_000: 400}.get(events_rows, max(1, int(events_rows**0.5)))


def events_surface(spark: SparkSession, sf_dir: str, tilted: bool = False) -> tuple[DataFrame, GridSpec]:
    """nodes (node, z long) and grid of the surface derived from ``events``: an elevation of its own for every node."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("node"), "value")
    n = e.count()
    nx = columns_of(n)
    spec = GridSpec(nx, -(-n // nx))
    z = F.floor(F.col("value") * 100 + 0.5).cast("long") * 1_000_000 + F.col("node")
    if tilted:
        z = z + F.lit(20_000_000_000) * spec.row(F.col("node"))
    return e.select("node", z.alias("z")), spec
