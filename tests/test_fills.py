"""Fills that drain, their options, lakes as routes, and the hierarchy of depressions, against plain versions."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from talweg.functions.grid import GridSpec
from talweg.operators import builder, depressions, flats, flow, hierarchy
from talweg.operators.iterate import to_root

SPEC = GridSpec(9, 8)


def surface(spark, seed, heights=12):
    """A surface of few heights, so that it has flats, pits and lakes."""
    rng = random.Random(seed)
    return builder.codes(spark.createDataFrame([(k, float(rng.randrange(heights))) for k in range(SPEC.size)], "node long, z double"), SPEC).cache()


def around(node):
    r, c = divmod(node, SPEC.nx)
    return [(r + i) * SPEC.nx + c + j for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= r + i < SPEC.ny and 0 <= c + j < SPEC.nx]


def rim(node):
    r, c = divmod(node, SPEC.nx)
    return r in (0, SPEC.ny - 1) or c in (0, SPEC.nx - 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_node_drains_and_a_second_fill_changes_nothing(spark, seed):
    nodes = surface(spark, seed)
    out = flats.fill_draining(nodes, SPEC, 1e-3).cache()
    filled = {r.node: r.filled for r in out.collect()}
    assert all(rim(n) or any(filled[m] < z for m in around(n)) for n, z in filled.items())
    plain = {r.node: r.filled for r in depressions.fill(nodes, SPEC).collect()}
    assert all(0 <= filled[n] - z < 0.5 for n, z in plain.items())
    again = nodes.select("node", "bc").join(out.select("node", F.col("filled").alias("z")), "node")
    assert flats.fill_draining(again, SPEC, 1e-3).filter("filled <> z or steps <> 0").count() == 0


def test_options(spark):
    nodes = surface(spark, 3)
    plain = {r.node: r.filled for r in depressions.fill(nodes, SPEC).collect()}
    flat = {r.node: (r.filled, r.steps) for r in flats.fill_draining(nodes, SPEC, preserve_flat=True).collect()}
    assert flat == {n: (z, 0) for n, z in plain.items()}
    shallow = flats.fill_draining(nodes, SPEC, max_depth=2.0, preserve_flat=True).collect()
    assert all(r.filled == (plain[r.node] if plain[r.node] - r.z <= 2 else r.z) for r in shallow) and any(r.filled == r.z < plain[r.node] for r in shallow)
    level = nodes.withColumn("z", F.lit(1.0))
    steps = {r.node: r.steps for r in flats.fill_draining(level, SPEC).collect()}
    assert all(s == 2 * min(n // 9, n % 9, 7 - n // 9, 8 - n % 9) for n, s in steps.items())
    assert flats.fill_draining(level, SPEC, rounds=1).agg(F.max("steps")).first()[0] <= 4


@pytest.mark.parametrize("method", ["carve", "simple", "fill"])
def test_reroutes_reach_the_rim(spark, method):
    nodes = surface(spark, 5, 100_000)
    sfd = flow.steepest(nodes, SPEC)
    out = depressions.reroute(nodes, sfd, SPEC, method=method)
    assert to_root(out).filter(f"root % {SPEC.nx} not in (0, {SPEC.nx - 1}) and floor(root / {SPEC.nx}) not in (0, {SPEC.ny - 1})").count() == 0
    with pytest.raises(ValueError):
        depressions.reroute(nodes, sfd, SPEC, method="other")


def plain_tree(z, basin, spill):
    """Depressions by raising water from pass to pass, with all their cells each time."""
    passes = {}
    for n in z:
        for m in around(n):
            a, b = basin[n], basin[m]
            if a < b:
                passes[a, b] = min(passes.get((a, b), 1e18), max(z[n], z[m]))
    found = {(b, 1): [{b}, None, spill[b], None] for b in spill}
    now = {b: (b, 1) for b in spill}
    for p, a, b in sorted((p, a, b) for (a, b), p in passes.items()):
        if a in spill and b in spill and p < min(spill[a], spill[b]) and now[a] != now[b]:
            x, y = now[a], now[b]
            members = found[x][0] | found[y][0]
            key = (min(members), len(members))
            for k in (x, y):
                found[k][2:] = [p, key]
            found[key] = [members, p, spill[a], None]
            for m in members:
                now[m] = key
    out = set()
    for (label, n), (members, formed, level, parent) in found.items():
        wet = [z[c] for c in z if basin[c] in members and z[c] < level]
        out.add((label, n, formed, level, *(parent or (None, None)), len(wet), round(len(wet) * level - sum(wet), 6)))
    return out


@pytest.mark.parametrize("seed", [1, 4, 7])
def test_hierarchy_equals_a_plain_one(spark, seed):
    nodes = surface(spark, seed, 1_000_000)
    sfd = flow.steepest(nodes, SPEC).cache()
    z = {r.node: r.z for r in nodes.collect()}
    basin = {r.node: r.root for r in to_root(sfd).collect()}
    level, heap = {}, [(z[n], n) for n in z if rim(n)]
    heapq.heapify(heap)
    while heap:  # heights over which each node reaches the rim
        h, n = heapq.heappop(heap)
        if n not in level:
            level[n] = h
            for m in around(n):
                heapq.heappush(heap, (max(h, z[m]), m))
    spill = {b: level[b] for b in set(basin.values()) if not rim(b)}
    got = {(r.label, r.n_basins, r.formed, r.spill, r.parent_label, r.parent_basins, r.n_cells, round(r.volume, 6)) for r in hierarchy.hierarchy(nodes, sfd, SPEC).collect()}
    assert got == plain_tree(z, basin, spill)


@pytest.mark.parametrize("seed", [1, 7])
def test_hierarchy_where_spills_go_by_tiles_and_cells_in_parts(spark, monkeypatch, seed):
    """Beyond DRIVER_PASSES spills are found over the passes' nodes, which the hierarchy had left out: an error before."""
    nodes = surface(spark, seed, 1_000_000)
    sfd = flow.steepest(nodes, SPEC).cache()
    plain = hierarchy.hierarchy(nodes, sfd, SPEC).collect()
    monkeypatch.setattr(depressions, "DRIVER_PASSES", 0)
    monkeypatch.setattr(hierarchy, "BASINS", 2)
    monkeypatch.setattr(hierarchy, "CELLED", 1)
    assert sorted(hierarchy.hierarchy(nodes, sfd, SPEC).collect(), key=str) == sorted(plain, key=str)
