"""Measures of voxel objects, against counts of cells and numpy's eigenvalues."""

import itertools
import random

import numpy as np
import pytest

from talweg.operators import shapes

CUBE = list(itertools.product(range(3), repeat=3))
SHAPES = {
    "one": ([(5, -2, 7)], 1),
    "block": (CUBE, 1),
    "hollow": ([p for p in CUBE if p != (1, 1, 1)], 2),
    "ring": ([p for p in CUBE if p[2] == 0 and p != (1, 1, 0)], 0),
    "bar": ([(0, y, 0) for y in range(6)], 1),
}


def table(spark, rows):
    return spark.createDataFrame([(*r, c) for r, c in rows], "x long, y long, z long, component long")


@pytest.mark.parametrize("connectivity", [6, 26])
def test_known_shapes(spark, connectivity):
    rows = [(p, i) for i, (cells, _) in enumerate(SHAPES.values()) for p in [(x + 20 * i, y, z) for x, y, z in cells]]
    got = {r.component: r for r in shapes.objects(table(spark, rows + rows[:9]), connectivity).collect()}
    for i, (cells, euler) in enumerate(SHAPES.values()):
        r, there, p = got[i], set(cells), np.array(cells, float)
        faces = sum((x + a, y + b, z + c) not in there for x, y, z in cells for a, b, c in [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])
        assert (r.volume, r.area, r.euler) == (len(cells), faces, euler)
        assert (r.x_min, r.x_max, r.z_min, r.z_max) == (p[:, 0].min() + 20 * i, p[:, 0].max() + 20 * i, p[:, 2].min(), p[:, 2].max())
        want = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(p.T, bias=True)) if len(p) > 1 else np.zeros(3), 0))[::-1]
        assert [r.length1, r.length2, r.length3] == pytest.approx(want, abs=1e-6)
    assert got[0].elongation is None and got[4].elongation == pytest.approx(1)
    assert got[0].sphericity == pytest.approx(np.pi ** (1 / 3) * 6 ** (2 / 3) / 6)


def test_segmented_against_cells(spark):
    rng = random.Random(3)
    places = [(rng.randint(0, 8), rng.randint(0, 8), rng.randint(0, 8)) for _ in range(300)]
    vox = spark.createDataFrame([(*p, float(i % 5)) for i, p in enumerate(set(places))], "x long, y long, z long, value double")
    for connectivity in (6, 26):
        labels, found = shapes.segmented(vox, connectivity)
        sets = {}
        for r in labels.collect():
            sets.setdefault(r.component, set()).add((r.x, r.y, r.z))
        got = {r.component: r.euler for r in found.collect()}
        assert got.keys() == sets.keys()
        for c, s in sets.items():
            if connectivity == 26:
                cells = {tuple(2 * v + 1 + d for v, d in zip(p, o)) for p in s for o in itertools.product((-1, 0, 1), repeat=3)}
                assert got[c] == sum((-1) ** sum(v % 2 for v in q) for q in cells)
            else:
                boxes = [b for b in itertools.product((0, 1), repeat=3)]
                full = lambda p, b: all(tuple(i + j for i, j in zip(p, o)) in s for o in itertools.product(*[range(k + 1) for k in b]))
                assert got[c] == sum((-1) ** sum(b) for p in s for b in boxes if full(p, b))
    assert shapes.segmented(vox, 6, vox["value"] > 99)[1].count() == 0
    with pytest.raises(ValueError):
        shapes.objects(labels, 18)
