"""Shortest ways by tiles and landmarks, against a search with a queue."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from talweg import scratch
from talweg.functions.grid import GridSpec
from talweg.operators import routes
from talweg.operators.neighbours import neighbours
from talweg.operators.voxels import ring


def searched(graph, start):
    best, heap = {}, [(0.0, start)]
    while heap:
        d, p = heapq.heappop(heap)
        if p not in best:
            best[p] = d
            for q, w in graph.get(p, {}).items():
                heapq.heappush(heap, (d + w, q))
    return best


def way_back(graph, best, start, goal):
    if goal not in best:
        return []
    way = [goal]
    while way[-1] != start:
        v = way[-1]
        way.append(min((best[u], u) for u in graph[v] if u in best and abs(best[u] + graph[u][v] - best[v]) < 1e-9)[1])
    return way[::-1]


@pytest.mark.parametrize("seed,hole", [(2, 0.3)])
def test_route_on_a_grid(spark, seed, hole):
    rng, spec = random.Random(seed), GridSpec(17, 13)
    rows = [(n, rng.randint(0, 5)) for n in range(spec.size) if rng.random() >= hole]
    nodes = spark.createDataFrame(rows, "node long, z long")
    e = neighbours(nodes, spec).select("node", "nb", (F.floor(F.col("dx") * 10) + F.abs(F.col("z") - F.col("z_nb"))).alias("w")).cache()
    graph = {}
    for r in e.collect():
        graph.setdefault(r.node, {})[r.nb] = float(r.w)
    marks = routes.extreme_nodes(e, spec)
    table = routes.landmark_distances(e, spec, marks, "w", side=4)
    want = [searched(graph, m) for m in marks]
    assert {r.node: list(r.d) for r in table.collect()} == {n: [w.get(n) for w in want] for n in set().union(*want)}
    known = [n for n, _ in rows]
    for start, goal in [(known[0], known[-1]), (known[5], known[5]), (known[0], -1)]:
        best = searched(graph, start)
        way, seen, rounds = routes.shortest_route(e, spec, table, start, goal, "w", side=4)
        got = [(r.node, r.value) for r in way.orderBy("step").collect()]
        assert got == [(n, best[n]) for n in way_back(graph, best, start, goal)]
        assert [r.step for r in way.orderBy("step").collect()] == list(range(len(got)))
        if len(got) > 1:
            assert seen.count() <= len(best) and rounds <= max(len(got), 3)
            assert all(r.value >= best[r.node] for r in seen.collect())
    # landmarks of another part of the graph bound nothing, and nothing is lost by that
    far = routes.shortest_route(e, spec, table.limit(0), known[0], known[-1], "w", side=4)[0]
    assert far.count() == len(way_back(graph, searched(graph, known[0]), known[0], known[-1]))


def test_a_bound_leaves_most_nodes_out(spark):
    spec = GridSpec(40, 40)
    nodes = spark.range(spec.size).select(F.col("id").alias("node"), F.lit(0).alias("z"))
    e = neighbours(nodes, spec)
    table = routes.landmark_distances(e, spec, routes.extreme_nodes(e, spec), side=8)
    way, seen, rounds = routes.shortest_route(e, spec, table, 41, 41 + 25, side=8)
    assert way.count() == 26 and seen.count() < 200 and rounds < 12


@pytest.mark.parametrize("connectivity", [6, 26])
def test_route_through_voxels(spark, connectivity):
    rng = random.Random(connectivity)
    places = [(x, y, z) for x in range(-3, 5) for y in range(6) for z in range(5) if rng.random() < 0.7 or (x, y, z) in ((-3, 0, 0), (4, 5, 4))]
    vox = spark.createDataFrame([(*p, 1.0) for p in places] + [(40, 40, 40, 1.0)], "x long, y long, z long, value double")
    there = set(places)

    def graph_of(cells):
        moves = [(m, sum(map(abs, m)) ** 0.5) for m in ring(connectivity)]
        return {p: {q: w for m, w in moves if (q := tuple(i + j for i, j in zip(p, m))) in cells} for p in cells}

    start, goal = (-3, 0, 0), (4, 5, 4)
    graph = graph_of(there)
    best = searched(graph, start)
    got = routes.voxel_route(vox, start, goal, connectivity, side=3).orderBy("step").collect()
    assert got[-1].value == pytest.approx(best[goal])
    assert [(r.x, r.y, r.z) for r in got] == way_back(graph, best, start, goal) if connectivity == 6 else len(got) > 5
    assert all((b.x - a.x, b.y - a.y, b.z - a.z) in ring(connectivity) for a, b in zip(got, got[1:]))
    assert routes.voxel_route(vox, start, (40, 40, 40), connectivity).count() == 0
    assert routes.voxel_route(vox, start, (9, 9, 9), connectivity).count() == 0
    assert [tuple(r) for r in routes.voxel_route(vox, start, start, connectivity).collect()] == [(0, *start, 0.0)]
    ways, cells = routes.separate_routes(vox, start, goal, 2, 1, connectivity).collect(), set(there)
    for k in range(1, 3):
        best = searched(graph_of(cells), start)
        mine = sorted((r for r in ways if r.route == k), key=lambda r: r.step)
        if goal not in best:
            assert not [r for r in ways if r.route >= k]
            break
        assert mine[-1].value == pytest.approx(best[goal]) and {(r.x, r.y, r.z) for r in mine} <= cells
        shut = {(r.x + a, r.y + b, r.z + c) for r in mine for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}
        cells -= {p for p in shut if all(max(abs(i - j) for i, j in zip(p, q)) > 1 for q in (start, goal))}
    assert {r.route for r in ways} == ({1, 2} if connectivity == 6 else {1})  # a way through the middle shuts this box
    assert {r.route for r in routes.separate_routes(vox, start, goal, 2, 1, connectivity, open_ends=False).collect()} == {1}


def test_no_voxels(spark):
    none = spark.createDataFrame([], "x long, y long, z long, value double")
    assert routes.voxel_route(none, (0, 0, 0), (1, 1, 1)).count() == 0
    assert routes.separate_routes(none, (0, 0, 0), (1, 1, 1)).count() == 0


def test_a_way_through_a_wide_flat_box_takes_few_tables(spark, monkeypatch):
    """Blocks of 48 voxels a side and a table for each doubling of the way's pointers before: over 20 tables."""
    walls = {(x, y) for x in range(10, 300, 20) for y in range(20) if y != (0 if x % 40 == 10 else 19)}
    places = [(x, y, z) for x in range(300) for y in range(20) if (x, y) not in walls for z in (0, 1)]
    vox = spark.createDataFrame(places, "x long, y long, z long").cache()
    tables = []
    monkeypatch.setattr(scratch, "scratch_path", lambda s, path=scratch.scratch_path: tables.append(path(s)) or tables[-1])
    got = routes.voxel_route(vox, (0, 0, 0), (299, 19, 1)).orderBy("step").collect()
    assert len(tables) < 8
    there = set(places)
    graph = {p: {q: 1.0 for m in ring(6) if (q := tuple(i + j for i, j in zip(p, m))) in there} for p in places}
    assert [(r.x, r.y, r.z) for r in got] == way_back(graph, searched(graph, (0, 0, 0)), (0, 0, 0), (299, 19, 1))
    assert len(got) > 500 and [r.value for r in got] == [r.step for r in got] == list(range(len(got)))


def test_ways_by_blocks_of_any_size_are_the_same(spark):
    rng = random.Random(5)
    places = [(x, y, z) for x in range(-7, 9) for y in range(11) for z in range(4) if rng.random() < 0.75 or (x, y, z) in ((-7, 0, 0), (8, 10, 3))]
    vox = spark.createDataFrame(places, "x long, y long, z long").cache()
    found = [sorted(routes.separate_routes(vox, (-7, 0, 0), (8, 10, 3), 2, 0, 18, side=side).collect()) for side in (4, None)]
    assert found[0] == found[1] and {r.route for r in found[0]} == {1, 2}
