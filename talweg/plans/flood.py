"""Shallow water over a grid: steady flooding, inertial flow, bed erosion, metrics and particle models."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import D4, GridSpec
from ..operators.accumulate import accumulate_mfd
from ..operators.flow import downhill, hydraulic_weights
from ..operators.iterate import levels
from ..operators.neighbours import neighbours, orthogonal
from ..scratch import cut


def velocity(h: Column, slope: Column, n: float = 0.033) -> Column:
    """Manning: h^(2/3) S^(1/2) / n."""
    return F.pow(h, F.lit(2 / 3)) * F.sqrt(F.greatest(slope, F.lit(0.0))) / n


def analytical_depth(q: Column, width: float, slope: Column, n: float = 0.033) -> Column:
    """The depth at which Manning's law carries a discharge."""
    return F.pow(q * n / (F.lit(width) * F.sqrt(F.greatest(slope, F.lit(1e-9)))), F.lit(0.6))


def steady_step(nodes: DataFrame, spec: GridSpec, rain: float, dt: float, n: float = 0.033, mode: str = "slope") -> DataFrame:
    """nodes (node, z, h[, bc]) after one step of steady flooding: discharge comes from all rain upstream over the
    water surface, and leaves each cell by Manning's law; dh = (Qin - Qout) dt / area, h not below 0. Adds q_in, q_out."""
    water = nodes.withColumn("bed", F.col("z")).withColumn("z", F.col("z") + F.col("h"))
    e = cut(hydraulic_weights(downhill(water, spec), spec, mode))
    q = accumulate_mfd(e, nodes, constant=rain * spec.cell_area, level=levels(e, nodes)).withColumnRenamed("value", "q_in")
    out = e.groupBy("node").agg(F.max(F.struct("slope", "width")).alias("s"))
    rows = nodes.drop("q_in", "q_out").join(q, "node").join(out, "node", "left")
    q_out = F.coalesce(F.col("s.width") * F.col("h") * velocity(F.col("h"), F.col("s.slope"), n), F.lit(0.0))
    rows = rows.withColumn("q_out", q_out)
    leaving = B.can_out(F.col("bc")) if "bc" in nodes.columns else spec.on_edge(spec.row(F.col("node")), spec.col(F.col("node")))
    h = F.when(leaving, F.col("h")).otherwise(F.greatest(F.col("h") + (F.col("q_in") - F.col("q_out")) * dt / spec.cell_area, F.lit(0.0)))
    return rows.withColumn("h", h).drop("s")


def inertial_step(nodes: DataFrame, links: DataFrame | None, spec: GridSpec, dt: float, rain: float = 0.0, n: float = 0.033, gravity: float = 9.81) -> tuple[DataFrame, DataFrame]:
    """One step of the semi-implicit inertial scheme (Bates, Horritt and Fewtrell, 2010).

    nodes (node, z, h), links (node, nb, q) to the right and below (none at first). Each link's flux comes from
    its two ends, each node's depth from its links: one join and one aggregate, no order of nodes.
    """
    sides = [o for o in D4 if o[1] + o[2] > 0]
    e = neighbours(nodes.select("node", "z", "h"), spec, sides, ["z", "h"])
    e = e.withColumn("q", F.lit(0.0)) if links is None else e.join(links.select("node", "nb", "q"), ["node", "nb"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    top, top_nb = F.col("z") + F.col("h"), F.col("z_nb") + F.col("h_nb")
    depth = F.greatest(top, top_nb) - F.greatest("z", "z_nb")
    slope = (top_nb - top) / F.col("dx")
    flux = (F.col("q") - gravity * depth * dt * slope) / (1 + gravity * dt * n * n * F.abs("q") / F.pow(depth, F.lit(7 / 3)))
    e = cut(e.select("node", "nb", "dx", F.when(depth > 0, flux).otherwise(0.0).alias("q")))
    change = e.select("node", (-F.col("q") / F.col("dx")).alias("d")).unionAll(e.select(F.col("nb").alias("node"), (F.col("q") / F.col("dx")).alias("d")))
    change = change.groupBy("node").agg(F.sum("d").alias("d"))
    h = F.greatest(F.col("h") + dt * (F.coalesce("d", F.lit(0.0)) + rain), F.lit(0.0))
    return nodes.join(change, "node", "left").withColumn("h", h).drop("d"), e.select("node", "nb", "q")


def courant_dt(nodes: DataFrame, spec: GridSpec, alpha: float = 0.7, gravity: float = 9.81, least: float = 1e-4, most: float = 10.0) -> float:
    """alpha dx / sqrt(g h), least over all nodes, within limits."""
    h = nodes.agg(F.max("h")).first()[0] or 0.0
    return float(min(max(alpha * min(spec.dx, spec.dy) / (gravity * h) ** 0.5, least), most)) if h > 0 else most


def shear_erosion(nodes: DataFrame, edges: DataFrame, ke: float = 1e-5, critical: float = 4.0, exponent: float = 1.5, density: float = 1000.0, gravity: float = 9.81) -> DataFrame:
    """node, tau, erosion: tau = rho g h S on the steepest way down the water surface; ke (tau - tau_c)^a above tau_c."""
    s = edges.groupBy("node").agg(F.max("slope").alias("slope"))
    tau = density * gravity * F.col("h") * F.coalesce("slope", F.lit(0.0))
    return nodes.join(s, "node", "left").select("node", tau.alias("tau"), F.when(tau > critical, ke * F.pow(F.greatest(tau - critical, F.lit(0.0)), F.lit(exponent))).otherwise(0.0).alias("erosion"))


def lateral_transfer(edges: DataFrame, nodes: DataFrame, spec: GridSpec, rate: float) -> DataFrame:
    """node, gain: material from the cells beside each steepest link that stand higher, by ``rate`` times the slope to them."""
    best = edges.groupBy("node").agg(F.max(F.struct("slope", "dir", "dr", "dc")).alias("m")).select("node", "m.dir", "m.dr", "m.dc")
    side = orthogonal(best, spec)
    both = side.select("node", F.col("left").alias("side")).unionAll(side.select("node", F.col("right").alias("side"))).filter("side is not null")
    z = nodes.select("node", "z")
    moved = both.join(z, "node").join(z.select(F.col("node").alias("side"), F.col("z").alias("z_side")), "side").filter("z_side > z")
    moved = moved.select("node", "side", (rate * (F.col("z_side") - F.col("z")) / spec.dx).alias("g"))
    return moved.select("node", F.col("g").alias("gain")).unionAll(moved.select(F.col("side").alias("node"), -F.col("g"))).groupBy("node").agg(F.sum("gain").alias("gain"))


def metrics(nodes: DataFrame, edges: DataFrame, spec: GridSpec, n: float = 0.033) -> DataFrame:
    """node, u, q_unit, q_total and the number of ways down the water surface."""
    s = edges.groupBy("node").agg(F.max("slope").alias("slope"), F.count(F.lit(1)).alias("ways"))
    rows = nodes.join(s, "node", "left")
    u = velocity(F.col("h"), F.coalesce("slope", F.lit(0.0)), n)
    return rows.select("node", u.alias("u"), (u * F.col("h")).alias("q_unit"), (u * F.col("h") * spec.dx).alias("q_total"), F.coalesce("ways", F.lit(0)).alias("ways"))


def convergence(nodes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: share of wet nodes whose Qout is within a tolerance of Qin, mean ratio, and total depth."""
    ratio = F.col("q_out") / F.col("q_in")
    wet = nodes.filter("q_in > 0")
    return wet.agg(F.avg((F.abs(ratio - 1) <= tolerance).cast("double")).alias("settled"), F.avg(ratio).alias("ratio"), F.sum("h").alias("depth"))


def with_inputs(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """nodes with a column input: discharge that enters at points (node, input), summed where they meet."""
    return nodes.join(points.groupBy("node").agg(F.sum("input").alias("input")), "node", "left").withColumn("input", F.coalesce("input", F.lit(0.0)))


def particles(nodes: DataFrame, spec: GridSpec, count: int, volume: float, seed: int = 0, steps: int = 10_000) -> DataFrame:
    """nodes (node, z, h) after precipitons rained on the grid one at a time, each wetting its way down.

    Each drop meets the water of the ones before it, so the grid is one task's work: for grids that fit one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        z, h = pdf["z"].to_numpy(float), pdf["h"].to_numpy(float).copy()
        rng = np.random.default_rng(seed)
        for start in rng.integers(0, len(z), count):
            node = int(start)
            for _ in range(steps):
                r, c = divmod(node, spec.nx)
                h[node] += volume / spec.cell_area
                if r in (0, spec.ny - 1) or c in (0, spec.nx - 1):
                    h[node] = max(0.0, h[node] - volume / spec.cell_area)
                    break
                around = [(r + a) * spec.nx + c + b for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
                drops = [(z[node] + h[node] - z[k] - h[k]) / (spec.dxy if abs(k - node) not in (1, spec.nx) else spec.dx) for k in around]
                best = int(np.argmax(drops))
                if drops[best] <= 0:
                    break
                h[node] -= volume / spec.cell_area
                node = around[best]
        return pd.DataFrame({"node": pdf["node"], "z": z, "h": h})

    return nodes.select("node", F.col("z").cast("double").alias("z"), F.col("h").cast("double").alias("h")).groupBy().applyInPandas(run, "node long, z double, h double")


def droplet_erosion(nodes: DataFrame, spec: GridSpec, droplets: int, tile: int = 256, seed: int = 0, inertia: float = 0.05, capacity: float = 4.0, erode: float = 0.3, deposit: float = 0.3, evaporate: float = 0.01, steps: int = 30) -> DataFrame:
    """node, z after droplets that carry sediment down; each tile of the grid is a task's work of its own, so
    droplets stop at the edges of tiles."""
    rc = spec.with_rowcol(nodes.select("node", F.col("z").cast("double").alias("z")))
    rc = rc.withColumn("tr", F.floor(F.col("r") / tile)).withColumn("tc", F.floor(F.col("c") / tile))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0 = r.min(), c.min()
        g = np.full((r.max() - r0 + 1, c.max() - c0 + 1), np.nan)
        g[r - r0, c - c0] = pdf["z"].to_numpy()
        g = np.where(np.isnan(g), np.nanmax(g), g)
        rng = np.random.default_rng([seed, int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])])
        rows, cols = g.shape
        for _ in range(max(1, droplets * g.size // spec.size) if min(rows, cols) > 2 else 0):
            y, x = rng.uniform(0, rows - 1.001), rng.uniform(0, cols - 1.001)
            dy = dx = load = 0.0
            speed, water = 1.0, 1.0
            for _ in range(steps):
                i, j = int(y), int(x)
                v, u = y - i, x - j
                a, b, d, e = g[i, j], g[i, j + 1], g[i + 1, j], g[i + 1, j + 1]
                gx, gy = (b - a) * (1 - v) + (e - d) * v, (d - a) * (1 - u) + (e - b) * u
                here = a * (1 - u) * (1 - v) + b * u * (1 - v) + d * (1 - u) * v + e * u * v
                dx, dy = dx * inertia - gx * (1 - inertia), dy * inertia - gy * (1 - inertia)
                size = float(np.hypot(dx, dy))
                if size < 1e-12:
                    break
                dx, dy = dx / size, dy / size
                y, x = y + dy, x + dx
                if not (0 <= y < rows - 1 and 0 <= x < cols - 1):
                    break
                k, m = int(y), int(x)
                v2, u2 = y - k, x - m
                there = g[k, m] * (1 - u2) * (1 - v2) + g[k, m + 1] * u2 * (1 - v2) + g[k + 1, m] * (1 - u2) * v2 + g[k + 1, m + 1] * u2 * v2
                fall = here - there
                can = max(fall, 0.01) * speed * water * capacity
                change = min(-fall, load) if fall < 0 else ((load - can) * deposit if load > can else -min((can - load) * erode, fall))
                load -= change
                for (p, q), w in (((i, j), (1 - u) * (1 - v)), ((i, j + 1), u * (1 - v)), ((i + 1, j), (1 - u) * v), ((i + 1, j + 1), u * v)):
                    g[p, q] += change * w
                speed = float(np.sqrt(max(speed * speed + fall, 0.0)))
                water *= 1 - evaporate
        return pd.DataFrame({"node": pdf["node"], "z": g[r - r0, c - c0]})

    return rc.groupBy("tr", "tc").applyInPandas(run, "node long, z double")
