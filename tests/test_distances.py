"""Distances of voxels to seeds, against the least over all seeds and against a search step by step."""

import heapq
import random

import pytest

from talweg.operators import distances


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "x long, y long, z long, value double")


def cases():
    rng = random.Random(8)
    spot = lambda n: (rng.randint(-n, n), rng.randint(-n, n), rng.randint(-n, n))
    return {
        "random": ([spot(6) for _ in range(200)], [spot(6) for _ in range(12)]),
        "seeds outside": ([spot(3) for _ in range(60)], [(20, -9, 4), (-15, 2, 30), (20, -9, 4)]),
        "one": ([(2, 2, 2)], [(2, 2, 2)]),
        "ties": ([(x, 0, 0) for x in range(9)], [(0, 4, 0), (8, 4, 0), (4, -4, 0)]),
        "far apart": ([(0, 0, 0), (400, 3, 0), (200, 0, 2)], [(399, 0, 0), (1, 1, 1)]),
    }


@pytest.mark.parametrize("name", cases())
def test_distances(spark, name):
    places, seeds = cases()[name]
    vox, sown = table(spark, places), table(spark, seeds)
    gaps = {p: [sorted((abs(a - b) for a, b in zip(p, s)), reverse=True) for s in seeds] for p in places}
    got = sorted(((r.x, r.y, r.z), r.d2) for r in distances.euclidean(vox, sown).collect())
    assert got == sorted((p, min(a * a + b * b + c * c for a, b, c in gaps[p])) for p in places)
    lengths = {(3, 4, 5): lambda a, b, c: 3 * a + b + c, (1,): lambda a, b, c: a + b + c, (1, 1, 1): lambda a, b, c: a}
    for steps, law in lengths.items():
        got = sorted(((r.x, r.y, r.z), r.distance) for r in distances.lattice(vox, sown, *steps).collect())
        assert got == sorted((p, min(law(*g) for g in gaps[p])) for p in places), steps


@pytest.mark.parametrize("steps", [(3, 4, 5), (1, 2**0.5, 3**0.5), (2, 3, 5.9), (2, 5, 5), (1, 1.2)])
def test_lattice_against_search(spark, steps):
    rng = random.Random(2)
    seeds = [(rng.randint(0, 5), rng.randint(0, 5), rng.randint(0, 5)) for _ in range(3)]
    places = [(x, y, z) for x in range(6) for y in range(6) for z in range(6)]
    best, heap = {}, [(0.0, s) for s in seeds]
    moves = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) <= len(steps)]
    while heap:
        d, p = heapq.heappop(heap)
        if p in best:
            continue
        best[p] = d
        for m in moves:
            q = tuple(i + j for i, j in zip(p, m))
            if all(-3 <= i <= 8 for i in q):
                heapq.heappush(heap, (d + steps[sum(map(abs, m)) - 1], q))
    got = {(r.x, r.y, r.z): r.distance for r in distances.lattice(table(spark, places), table(spark, seeds), *steps).collect()}
    assert got == {p: pytest.approx(best[p]) for p in places}


def test_empty_and_refused(spark):
    some, none = table(spark, [(1, 2, 3), (1, 2, 3)]), table(spark, [(0, 0, 0)]).filter("x > 0")
    assert [r.d2 for r in distances.euclidean(some, none).collect()] == [None, None]
    assert [r.distance for r in distances.lattice(some, none, 3, 4, 5).collect()] == [None, None]
    assert distances.euclidean(none, some).count() == 0
    assert distances.lattice(none, none, 3, 4, 5).count() == 0
    with pytest.raises(ValueError):
        distances.lattice(some, some, 3, 2, 5)


def test_lattice_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(distances, "SIDE", 5)
    rng = random.Random(3)
    places = [(rng.randint(-9, 9), rng.randint(-9, 9), rng.randint(0, 6)) for _ in range(150)]
    for seeds in ([(-9, 9, 0)], [(rng.randint(-9, 9), rng.randint(-9, 9), rng.randint(0, 6)) for _ in range(4)]):
        got = sorted(((r.x, r.y, r.z), r.distance) for r in distances.lattice(table(spark, places), table(spark, seeds), 3, 4, 5).collect())
        law = lambda p, s: (lambda g: 3 * g[0] + g[1] + g[2])(sorted((abs(a - b) for a, b in zip(p, s)), reverse=True))
        assert got == sorted((p, min(law(p, s) for s in seeds)) for p in places)
