"""Spanning forests by nested tiles against plain ones, and the ways out along them."""

import random

import pytest
from pyspark.sql import functions as F

from talweg.functions.grid import D8, GridSpec
from talweg.operators import depressions, flow, graphs, spanning
from talweg.operators.builder import codes
from talweg.operators.neighbours import neighbours

SPEC = GridSpec(23, 19)


def links(seed, heights):
    rng = random.Random(seed)
    found = []
    for r in range(SPEC.ny):
        for c in range(SPEC.nx):
            for _, i, j in D8:
                if (i, j) > (0, 0) and 0 <= r + i < SPEC.ny and 0 <= c + j < SPEC.nx and rng.random() < 0.7:
                    found.append((r * SPEC.nx + c, (r + i) * SPEC.nx + c + j, rng.randrange(heights)))
    return found


def plain(edges):
    """The edges of the forest by w, k1, k2."""
    up, kept = {}, []

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for w, a, b, u, v in sorted(edges):
        p, q = top(u), top(v)
        if p != q:
            up[p] = q
            kept.append((w, a, b, u, v))
    return kept


@pytest.mark.parametrize("seed, heights, side", [(1, 5, 4), (2, 10_000, 3), (3, 40, 256)])
def test_forest_and_ways_out(spark, seed, heights, side):
    rng = random.Random(seed)
    open_ = {n for n in range(SPEC.size) if rng.random() < 0.03}
    rows = [(spanning.OUT if a in open_ else a, spanning.OUT if b in open_ else b, w, a, b) for a, b, w in links(seed, heights)]
    edges = spark.createDataFrame(rows, "u long, v long, w long, k1 long, k2 long")
    levels = spanning.forest(edges, SPEC, side)
    assert len(levels) == {4: 3, 3: 3, 256: 1}[side]
    want = plain([(w, a, b, u, v) for u, v, w, a, b in rows if u != v])
    got = sorted((r.w, r.k1, r.k2) for r in spanning.certain(levels).collect())
    assert got == sorted(x[:3] for x in want)
    near = {}
    for w, a, b, u, v in want:
        near.setdefault(u, []).append((v, w, a, b))
        near.setdefault(v, []).append((u, w, a, b))
    ways, front = {}, [(spanning.OUT, -1)]
    while front:
        n, h = front.pop()
        for m, w, a, b in near.get(n, ()):
            if m != spanning.OUT and m not in ways:
                ways[m] = (a, b, max(h, w))
                front.append((m, max(h, w)))
    assert {r.node: (r.k1, r.k2, r.value) for r in spanning.ways_out(levels, SPEC, side).collect()} == ways


def test_tree_of_a_grid_as_by_rounds(spark):
    nodes = spark.createDataFrame([(n, random.Random(n).randrange(50)) for n in range(SPEC.size)], "node long, z long")
    e = neighbours(nodes, SPEC).select("node", "nb", F.abs(F.col("z") - F.col("z_nb")).alias("w")).cache()
    assert sorted(graphs.spanning_tree(e, spec=SPEC).collect()) == sorted(graphs.spanning_tree(e).collect())


def test_spills_and_exits_take_few_rounds_over_many_tiles(spark, monkeypatch):
    """A ridge of basins that spill one into the next: a round for each of them before, and each round some tables."""
    spec = GridSpec(1025, 3)
    z = [10_000 if n // 1025 != 1 else (3 * (n % 1025) + 5 if n % 2 else 3 * (n % 1025)) for n in range(spec.size)]
    z[1025] = -1
    nodes = codes(spark.createDataFrame(list(enumerate(z)), "node long, z long"), spec).withColumn("bc", F.when(F.col("node") == 1025, F.col("bc")).otherwise(F.lit(1)).cast("byte")).cache()
    tables = []
    cut = spanning.cut
    for module in (spanning, depressions):
        monkeypatch.setattr(module, "cut", lambda df: tables.append(1) or cut(df))
    monkeypatch.setattr(depressions, "DRIVER_PASSES", 0)
    filled = {r.node: r.filled for r in depressions.fill(nodes, spec).collect()}
    assert len(tables) < 12
    high = -1
    for c in range(1, 1025):
        high = max(high, z[1025 + c])
        assert filled[1025 + c] == high
    sfd = flow.steepest(nodes, spec)
    moved = depressions.reroute(nodes, sfd, spec, method="simple").filter("rec <> node").count()
    assert moved == spec.size - 1
