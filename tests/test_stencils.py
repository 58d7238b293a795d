"""Neighbourhoods of voxels by blocks against plain ones, across the rims of blocks."""

import math
import random
from statistics import median

import pytest

from talweg.operators import stencils, voxels

XYZ = ("x", "y", "z")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(4)
    places = {tuple(rng.randrange(-5, 5) for _ in range(3)) for _ in range(400)} | {(30, 0, 0)}
    rows = {p: float(rng.randrange(100)) for p in places}
    return rows, spark.createDataFrame([(*p, v) for p, v in rows.items()], "x long, y long, z long, value double").cache()


def moved(p, o):
    return tuple(a + b for a, b in zip(p, o))


def values(df):
    got = {tuple(r[k] for k in XYZ): r[3] for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.mark.parametrize("side", [3, 64])
def test_stencils(cloud, monkeypatch, side):
    rows, vox = cloud
    monkeypatch.setattr(stencils, "SIDE", side)
    for k in (6, 18, 26):
        assert values(voxels.neighbour_count(vox, k)) == {p: sum(moved(p, o) in rows for o in voxels.ring(k)) for p in rows}
    assert values(voxels.median(vox)) == {p: median([rows[q] for q in [p, *[moved(p, o) for o in voxels.ring(26)]] if q in rows]) for p in rows}
    for spread in (None, 20.0):
        want = {}
        for p, v in rows.items():
            near = [(rows[moved(p, o)], sum(k * k for k in o)) for o in voxels.ring(26) if moved(p, o) in rows]
            w = [math.exp(-d / 2 - ((q - v) ** 2 / (2 * spread**2) if spread else 0)) for q, d in near]
            want[p] = (v + sum(a * q for a, (q, _) in zip(w, near))) / (1 + sum(w))
        got = values(voxels.gaussian(vox) if spread is None else voxels.bilateral(vox, 1.0, spread))
        assert got == pytest.approx(want)
    kernel = [(0, 0, 4), (-2, 1, 0)]
    for offsets, args in ((voxels.ring(6), {}), (kernel, {"kernel": kernel})):
        grown = rows | {moved(p, o): -1.0 for p in rows for o in offsets if moved(p, o) not in rows}
        assert values(voxels.dilate(vox, -1.0, **args)) == grown
        kept = {p: v for p, v in grown.items() if all(moved(p, o) in grown for o in offsets)}
        assert values(voxels.erode(voxels.dilate(vox, -1.0, **args), **args)) == kept


def test_places_travel_once(cloud):
    """The 26 neighbours of a place were exploded and joined before."""
    for df in (voxels.neighbour_count(cloud[1], 26), voxels.bilateral(cloud[1]), voxels.median(cloud[1])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Aggregate") == 0
