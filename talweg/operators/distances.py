"""Distances from voxels to their nearest seed through free space, exact and without a bound on them."""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .voxels import XYZ

CELLS = 1 << 18
#: Side of a block of places that is one task's.
SIDE = 64


def _lowest(at: list[int], base: list[int], wanted: np.ndarray) -> np.ndarray:
    """The least of (t - at[i])^2 + base[i] at each wanted t, by the lower envelope of these parabolas; whole numbers."""
    kept: list[int] = []
    since: list[int] = []  # the last place before kept[k] is the lowest
    for i, q in enumerate(at):
        edge = -1 << 62
        while kept:
            p = kept[-1]
            edge = (base[i] + q * q - base[p] - at[p] * at[p]) // (2 * (q - at[p]))
            if edge > since[-1]:
                break
            kept.pop()
            since.pop()
            edge = -1 << 62
        kept.append(i)
        since.append(edge)
    best = np.asarray(kept)[np.searchsorted(np.asarray(since), wanted, "left") - 1]
    away = wanted - np.asarray(at)[best]
    return away * away + np.asarray(base)[best]


def _lines(rows: pd.DataFrame, axis: str) -> tuple[pd.DataFrame, dict[tuple[int, int], slice]]:
    """Cells in order of their lines along an axis, and where each line lies among them."""
    others = [k for k in XYZ if k != axis]
    rows = rows.sort_values([*others, axis], ignore_index=True)
    key = rows[others].to_numpy(np.int64)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.array([], np.int64)
    return rows, {tuple(key[i].tolist()): slice(i, j) for i, j in zip(starts, [*starts[1:], len(key)])}


def _dealt(axis: str, length: int) -> list[Column]:
    """Groups of neighbouring lines along an axis, of about CELLS places whatever their length."""
    side = max(1, int((CELLS / max(1, length)) ** 0.5))
    return [F.floor(F.col(k) / side).alias(f"_{k}") for k in XYZ if k != axis]


def _along(cells: DataFrame, axis: str, low: int, high: int) -> DataFrame:
    """x, y, z, d2 of every place between low and high on each line of cells along an axis."""
    others = [k for k in XYZ if k != axis]
    wanted = np.arange(low, high + 1, dtype=np.int64)

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows, lines = _lines(rows, axis)
        at, base, n = rows[axis].tolist(), rows["d2"].tolist(), len(wanted)
        keys = np.repeat(np.array(list(lines), np.int64), n, axis=0)
        d2 = np.concatenate([_lowest(at[s], base[s], wanted) for s in lines.values()])
        return pd.DataFrame({others[0]: keys[:, 0], others[1]: keys[:, 1], axis: np.tile(wanted, len(lines)), "d2": d2})[[*XYZ, "d2"]]

    return cells.groupBy(*_dealt(axis, high - low + 1)).applyInPandas(spread, "x long, y long, z long, d2 long")


def euclidean(vox: DataFrame, seeds: DataFrame) -> DataFrame:
    """x, y, z, d2, distance: the Euclidean distance of each voxel to its nearest seed, and its square (a whole number).

    Separable: along x, y and z in turn, the lower envelope of the parabolas over a line's cells. A task takes a group of
    neighbouring lines of about CELLS places (one line at least, as long as the box of the voxels at most). Lines without
    seeds don't exist until a pass reaches them, and the last pass gives voxels only. No seeds: null. Repeated seeds count
    once, repeated voxels each.
    """
    places = vox.select(*[F.col(k).cast("long").alias(k) for k in XYZ])
    box = places.agg(*[f(k).alias(f"{k}{n}") for k in XYZ for n, f in (("0", F.min), ("1", F.max))]).first()
    cells = seeds.select(*[F.col(k).cast("long").alias(k) for k in XYZ]).distinct().withColumn("d2", F.lit(0).cast("long"))
    if box["x0"] is None:
        return places.select(*XYZ, F.lit(None).cast("long").alias("d2"), F.lit(None).cast("double").alias("distance"))
    cells = _along(_along(cells, "x", box["x0"], box["x1"]), "y", box["y0"], box["y1"])

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, wanted = _lines(left, "z")
        right, lines = _lines(right, "z")
        goal, at, base = left["z"].to_numpy(np.int64), right["z"].tolist(), right["d2"].tolist()
        d2, found = np.zeros(len(left), np.int64), np.zeros(len(left), bool)
        for key, s in wanted.items():
            if key in lines:
                d2[s], found[s] = _lowest(at[lines[key]], base[lines[key]], goal[s]), True
        return left.assign(d2=pd.Series(d2, dtype="Int64").where(found))

    by = _dealt("z", box["z1"] - box["z0"] + 1)
    both = places.groupBy(*by).cogroup(cells.groupBy(*by))
    return both.applyInPandas(settle, "x long, y long, z long, d2 long").withColumn("distance", F.sqrt("d2"))


def _ways(face: float, edge: float, corner: float) -> Iterator[tuple[tuple[int, int, int], float]]:
    """One of each pair of opposite steps with its length, those over corners first; steps of no use are left out."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    for step in sorted(steps, key=lambda s: -sum(map(abs, s))):
        length = {1: face, 2: edge, 3: corner}[sum(map(abs, step))]
        if length < inf:
            yield step, length


def lattice(vox: DataFrame, seeds: DataFrame, face: float, edge: float = inf, corner: float = inf) -> DataFrame:
    """x, y, z, distance: the length of the shortest way from each voxel to a seed by steps over faces, edges and corners
    of these lengths: (3, 4, 5) is the chamfer distance, (1, 2**0.5, 3**0.5) that of straight steps, (1) Manhattan's.

    Lengths shall not fall from face to edge to corner. Then a shortest way never goes to and fro along an axis, so its
    places lie between its ends, and since nothing is in its way its steps can be put in any order: along each of the 13
    directions in turn. A task does so for a block, whose places are an array; a block hands the values of its rim on to
    those beside it, and only blocks that got something better go another round. Values get into a block from places
    outside it, so a block and the rim around it are solved together. No seeds: null. Repeated seeds count once, repeated
    voxels each.
    """
    if not 0 < face <= edge <= corner:
        raise ValueError("lengths of steps must not fall from face to edge to corner")
    places = vox.select(*[F.col(k).cast("long").alias(k) for k in XYZ])
    seeded = seeds.select(*[F.col(k).cast("long").alias(k) for k in XYZ]).distinct()
    box = places.unionAll(seeded).agg(*[F.struct(F.min(k), F.max(k)).alias(k) for k in XYZ]).first()
    if box["x"][0] is None:
        return places.withColumn("distance", F.lit(None).cast("double"))
    low, size = [box[k][0] for k in XYZ], [box[k][1] - box[k][0] + 1 for k in XYZ]
    ways, by = list(_ways(face, edge, corner)), ["bx", "by", "bz"]
    block = [F.floor((F.col(k) - lo) / SIDE).alias(b) for k, lo, b in zip(XYZ, low, by)]

    def solved(of: list[int], rows: pd.DataFrame) -> tuple[np.ndarray, list[int]]:
        """The values of a block and the rim around it, as far as the box goes, and its first place."""
        first = [lo + b * SIDE - 1 for lo, b in zip(low, of)]
        f = np.full([min(SIDE, lo + s - at - 1) + 2 for lo, s, at in zip(low, size, first)], np.inf)
        np.minimum.at(f, tuple(rows[k].to_numpy(np.int64) - at for k, at in zip(XYZ, first)), rows["f"].to_numpy())
        for step, length in ways:
            axis = next(i for i, d in enumerate(step) if d)
            g = np.moveaxis(f, axis, 0)  # a view: its slices along the axis are passed one after the other
            rest = [d for i, d in enumerate(step) if i != axis]
            to = tuple(slice(max(d, 0), n + min(d, 0)) for d, n in zip(rest, g.shape[1:]))
            back = tuple(slice(max(-d, 0), n + min(-d, 0)) for d, n in zip(rest, g.shape[1:]))
            for i in range(1, len(g)):
                np.minimum(g[i][to], g[i - 1][back] + length, out=g[i][to])
            for i in range(len(g) - 2, -1, -1):
                np.minimum(g[i][back], g[i + 1][to] + length, out=g[i][back])
        return f, first

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f, first = solved(list(key), rows)
        inner = np.zeros(f.shape, bool)
        inner[1:-1, 1:-1, 1:-1] = True
        edge_of = inner.copy()
        edge_of[2:-2, 2:-2, 2:-2] = False
        at = np.argwhere(edge_of & np.isfinite(f))  # the block's own outermost places: rim of those beside it
        value, at = f[tuple(at.T)], at + np.array(first)
        own, out = np.array(key), []
        for d in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]:
            to = own + np.array(d)
            start = np.array(low) + to * SIDE
            near = ((at >= start - 1) & (at <= start + SIDE)).all(axis=1)
            if (to < 0).any() or (to * SIDE >= np.array(size)).any() or not near.any():
                continue
            out.append(pd.DataFrame(dict(zip(by, to.tolist())) | dict(zip(XYZ, at[near].T)) | {"f": value[near]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*by, *XYZ, "f"]})

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left[XYZ].assign(distance=None)
        f, first = solved(list(key), right)
        value = f[tuple(left[k].to_numpy(np.int64) - at for k, at in zip(XYZ, first))]
        return left[XYZ].assign(distance=value)

    whole = [*by, *XYZ]
    inbox = fresh = cut(seeded.select(*block, *XYZ, F.lit(0.0).alias("f")))
    while True:
        mail = inbox.join(fresh.select(*by).distinct(), by, "left_semi")
        sent = mail.groupBy(*by).applyInPandas(send, "bx long, by long, bz long, x long, y long, z long, f double")
        sent = sent.groupBy(*whole).agg(F.min("f").alias("got"))
        both = inbox.join(sent.hint("merge"), whole, "full")
        # sums of rounded lengths differ by the order of their steps
        better = F.col("got").isNotNull() & (F.col("f").isNull() | (F.col("got") < F.col("f") * (1 - 1e-12)))
        both = cut(both.select(*whole, F.when(better, F.col("got")).otherwise(F.col("f")).alias("f"), better.alias("better")))
        fresh, inbox = both.filter("better").drop("better"), both.drop("better")
        if fresh.isEmpty():
            break
    split = places.select(*block, *XYZ)
    return split.groupBy(*by).cogroup(inbox.groupBy(*by)).applyInPandas(finish, "x long, y long, z long, distance double")
