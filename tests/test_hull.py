"""Corners of hulls, against planes through all triples of points."""

import itertools
import random

import numpy as np
import pytest

from talweg.operators import hull


def plain(points):
    """Corners by definition: points whose supporting planes through triples have three independent normals."""
    p = np.array(sorted(set(points)))
    planes = {}
    for t in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        side = (p - p[t[0]]) @ n
        if n.any() and ((side <= 0).all() or (side >= 0).all()):
            for v in np.flatnonzero(side == 0):
                planes.setdefault(v, []).append(n)
    return sorted(tuple(p[v].tolist()) for v, n in planes.items() if np.linalg.matrix_rank(np.array(n)) == 3)


def spots(seed, n, size):
    rng = random.Random(seed)
    return [tuple(rng.randint(-size, size) for _ in range(3)) for _ in range(n)]


@pytest.mark.parametrize("points", [spots(k, n, s) for k, (n, s) in enumerate([(4, 3), (12, 2), (30, 2), (40, 3), (40, 9), (25, 1)])] + [list(itertools.product(range(3), repeat=3))])
def test_solid_hulls(points):
    assert sorted(map(tuple, hull.corners_of(np.array(points)).tolist())) == plain(points)


def test_flat_hulls():
    of = lambda p: sorted(map(tuple, hull.corners_of(np.array(p)).tolist()))
    assert of([(1, 2, 3)]) == of([(1, 2, 3), (1, 2, 3)]) == [(1, 2, 3)]
    assert of([(k, 2 * k, -k) for k in (3, 1, 2, 0)]) == [(0, 0, 0), (3, 6, -3)]
    square = [(x, y, x + y) for x in range(4) for y in range(4)]
    assert of(square) == [(0, 0, 0), (0, 3, 3), (3, 0, 3), (3, 3, 6)]
    assert of([(5, y, z) for y in range(3) for z in range(2)]) == [(5, 0, 0), (5, 0, 1), (5, 2, 0), (5, 2, 1)]
    with pytest.raises(ValueError):
        hull.corners_of(np.array([(0, 0, 0), (1, 1, 1), (1 << 21, 0, 0)]))


def test_hull_by_parts(spark, monkeypatch):
    ball = [(x, y, z) for x, y, z in itertools.product(range(-9, 10), repeat=3) if x * x + 2 * y * y + 3 * z * z <= 80]
    names = "x long, y long, z long, value double"
    vox = spark.createDataFrame([(*p, 1.0) for p in ball + ball[:50]] + [(50, 50, 50, 9.0)], names)
    want = sorted(map(tuple, hull.corners_of(np.array(ball)).tolist()))
    monkeypatch.setattr(hull, "PART", 16)
    assert sorted(map(tuple, hull.convex_hull(vox, vox["value"] < 5).collect())) == want
    assert hull.convex_hull(vox.limit(0)).count() == 0
