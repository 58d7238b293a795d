"""Corners of the convex hull of voxels: hulls of parts are merged as a tree, and only corners go on."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .voxels import XYZ

#: Places of a part at first, parts merged at a time, and the side of the box up to which 64-bit products are exact.
PART, MERGED, SIDE = 1 << 15, 8, 1 << 20


def _flat(points: np.ndarray, drop: int) -> np.ndarray:
    """Corners of points in a plane, by the two axes other than ``drop``: chains below and above in order of place."""
    u, v = [k for k in range(3) if k != drop]
    points = points[np.lexsort((points[:, v], points[:, u]))]
    corners: list[int] = []
    for order in (range(len(points)), range(len(points) - 1, -1, -1)):
        chain: list[int] = []
        for i in order:
            while len(chain) > 1:
                a, b, c = points[chain[-2]], points[chain[-1]], points[i]
                if (b[u] - a[u]) * (c[v] - a[v]) - (b[v] - a[v]) * (c[u] - a[u]) > 0:
                    break
                chain.pop()
            chain.append(i)
        corners += chain
    return points[sorted(set(corners))]


def _solid(points: np.ndarray, first: list[int]) -> np.ndarray:
    """Corners of points not in one plane. The hull grows from four of them: a point outside replaces the triangles that
    it sees by ones to the edge of what it sees. Points left inside a side or an edge of the hull are no corners: theirs
    are fewer than three independent normals."""
    inside = points[first].sum(axis=0)  # four times a point within

    def facing(a: int, b: int, c: int) -> tuple[tuple[int, int, int], np.ndarray, int]:
        normal = np.cross(points[b] - points[a], points[c] - points[a])
        level = int(normal @ points[a])
        return ((a, b, c), normal, level) if int(normal @ inside) < 4 * level else ((a, c, b), -normal, -level)

    faces = [facing(*f) for f in combinations(first, 3)]
    normals, levels = np.array([f[1] for f in faces]), np.array([f[2] for f in faces])
    names = [f[0] for f in faces]
    far = np.abs(4 * points - inside).max(axis=1)
    for i in np.argsort(-far, kind="stable").tolist():
        seen = normals @ points[i] > levels
        if not seen.any():
            continue
        edges = {(names[k][j], names[k][(j + 1) % 3]) for k in np.flatnonzero(seen) for j in range(3)}
        new = [facing(a, b, i) for a, b in edges if (b, a) not in edges]
        names = [names[k] for k in np.flatnonzero(~seen)] + [f[0] for f in new]
        normals = np.concatenate([normals[~seen], [f[1] for f in new]])
        levels = np.concatenate([levels[~seen], [f[2] for f in new]])
    normals //= np.gcd.reduce(normals, axis=1)[:, None]
    around: dict[int, set] = {}
    for name, normal in zip(names, normals.tolist()):
        for v in name:
            around.setdefault(v, set()).add(tuple(normal))
    corners = [v for v, n in around.items() if np.linalg.matrix_rank(np.array(list(n), float) / np.abs(list(n)).max(axis=1, keepdims=True)) == 3]
    return points[sorted(corners)]


def corners_of(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of whole-numbered points, without those within a side or an edge."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    low = points.min(axis=0)
    p = points - low
    if p.max() >= SIDE:
        raise ValueError(f"a hull is for boxes with sides below {SIDE}")
    b = int(np.abs(p - p[0]).sum(axis=1).argmax())
    off = np.cross(p - p[0], p[b] - p[0])
    c = int(np.abs(off).max(axis=1).argmax())
    if not off[c].any():
        return points[[0, -1]]  # a line, in order of place
    rise = (p - p[0]) @ off[c]
    d = int(np.abs(rise).argmax())
    if not rise[d]:
        return _flat(p, int(np.abs(off[c]).argmax())) + low
    return _solid(p, [0, b, c, d]) + low


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    found = pd.DataFrame(corners_of(rows[XYZ].to_numpy(np.int64)), columns=XYZ)
    return found.assign(part=rows["part"].iat[0] // MERGED)


def convex_hull(vox: DataFrame, where: Column | None = None) -> DataFrame:
    """x, y, z of the corners of the convex hull of voxels (that meet a condition); places within a side or an edge of it
    are none. Fewer than four places, lines and planes have the corners of what they are; no voxels have none.

    Only the ends of each straight row of voxels along an axis can be corners, so three groupings leave places in
    proportion to the box's surface. Those are dealt to parts, and eight parts' corners meet in a task: of a box of side
    n some n^1.5 at most for each part (Andrews' bound for whole-numbered corners).
    """
    left = (vox if where is None else vox.filter(where)).select(*[F.col(k).cast("long").alias(k) for k in XYZ]).dropna()
    for k in reversed(XYZ):
        ends = left.groupBy(*[c for c in XYZ if c != k]).agg(F.min(k).alias("_a"), F.max(k).alias("_b"))
        left = ends.withColumn(k, F.explode(F.array_distinct(F.array("_a", "_b")))).select(*XYZ)
    left = cut(left)
    parts = max(-(-left.count() // PART), 1)
    left = left.withColumn("part", F.pmod(F.xxhash64(*XYZ), F.lit(parts)))
    while True:
        left = cut(left.groupBy("part").applyInPandas(_merged, "x long, y long, z long, part long"))
        if parts == 1:
            return left.select(*XYZ)
        parts = -(-parts // MERGED)
