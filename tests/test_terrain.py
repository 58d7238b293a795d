"""The terrain engine against plain numpy versions and the invariants of flow graphs."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions import boundary as B
from talweg.functions.grid import D8, GridSpec
from talweg.operators import accumulate as A
from talweg.operators import builder, depressions, flow, graphs, rivers, terrain, voxels
from talweg.operators.iterate import levels, to_root
from talweg.operators.neighbours import bit_code, effective_neighbours, links, neighbours, neighbours_of_bits, one_neighbour, orthogonal, pair_by_angle, transfer_flow
from talweg.sources import grids

SPEC = GridSpec(13, 9, 2.0, 2.0)


@pytest.fixture(scope="module")
def z():
    return np.random.default_rng(4).integers(0, 1000, SPEC.size).astype(float) + np.arange(SPEC.size) / 1000


@pytest.fixture(scope="module")
def nodes(spark, z):
    return builder.codes(grids.from_array(spark, z), SPEC).cache()


def values(df, column="value"):
    return {r["node"]: r[column] for r in df.collect()}


def around(node, spec=SPEC):
    r, c = divmod(node, spec.nx)
    return [((r + dr) * spec.nx + c + dc, spec.length(dr, dc)) for _, dr, dc in D8 if 0 <= r + dr < spec.ny and 0 <= c + dc < spec.nx]


def flood(z, spec=SPEC):
    done, heap = {}, [(z[n], n) for n in range(spec.size) if spec.nx > 0 and (n // spec.nx in (0, spec.ny - 1) or n % spec.nx in (0, spec.nx - 1))]
    heapq.heapify(heap)
    while heap:
        h, n = heapq.heappop(heap)
        if n in done:
            continue
        done[n] = h
        for k, _ in around(n, spec):
            if k not in done:
                heapq.heappush(heap, (max(h, z[k]), k))
    return done


def test_steepest_receiver_and_area(nodes, z):
    sfd = {r.node: r for r in flow.steepest(nodes.select("node", "z"), SPEC).collect()}
    want = {}
    for n in range(SPEC.size):
        best = max(((z[n] - z[k]) / d, -k) for k, d in around(n))
        want[n] = -best[1] if best[0] > 0 else n
    assert {n: r.rec for n, r in sfd.items()} == want
    area = dict.fromkeys(want, 1.0)
    for n in sorted(want, key=lambda n: -z[n]):
        if want[n] != n:
            area[want[n]] += area[n]
    s = flow.steepest(nodes.select("node", "z"), SPEC)
    assert values(A.accumulate_sfd(s)) == area
    assert A.sum_at_outlets(s, A.accumulate_sfd(s)).first()[0] == SPEC.size


def test_boundary_codes_give_and_receive(nodes):
    sfd = flow.steepest(nodes, SPEC).join(nodes, "node")
    assert sfd.filter((F.col("bc") == B.OUT) & (F.col("rec") != F.col("node"))).count() == 0
    assert sfd.filter((F.col("rec") != F.col("node")) & (F.col("slope") <= 0)).count() == 0


@pytest.mark.parametrize("method", ["freeman", "quinn", "holmgren", "seibert", "tarboton"])
def test_partitions_sum_to_one(nodes, method):
    e = flow.partition(flow.downhill(nodes, SPEC), method, 1.3)
    assert all(abs(r[1] - 1) < 1e-12 for r in e.groupBy("node").agg(F.sum("weight")).collect())


def test_levels_and_mfd_mass(nodes):
    e = flow.partition(flow.downhill(nodes.drop("bc"), SPEC), "freeman")
    lv = levels(e, nodes)
    bad = e.join(lv, "node").join(lv.selectExpr("node as nb", "level as l2"), "nb").filter("level <= l2")
    assert bad.count() == 0
    area = A.accumulate_mfd(e, nodes, level=lv)
    ends = area.join(e.select("node").distinct(), "node", "left_anti")
    assert ends.agg(F.sum("value")).first()[0] == pytest.approx(SPEC.size)


def test_fill_is_a_priority_flood(nodes, z):
    want = flood(z)
    assert values(depressions.fill(nodes, SPEC), "filled") == pytest.approx(want)
    assert values(depressions.fill_by_relaxation(nodes, SPEC), "filled") == pytest.approx(want)
    again = depressions.fill(nodes, SPEC).select("node", F.col("filled").alias("z"))
    assert values(depressions.fill(again, SPEC), "filled") == pytest.approx(want)


def test_fill_by_joins_agrees(nodes, z, monkeypatch):
    monkeypatch.setattr(depressions, "DRIVER_PASSES", 0)
    assert values(depressions.fill(nodes, SPEC), "filled") == pytest.approx(flood(z))


@pytest.mark.parametrize("carve", [True, False])
def test_rerouting_leaves_no_closed_basin(nodes, carve):
    sfd = depressions.reroute(nodes, flow.steepest(nodes, SPEC), SPEC, carve).cache()
    end = to_root(sfd).join(nodes.select(F.col("node").alias("root"), "bc"), "root")
    assert end.count() == SPEC.size
    assert end.filter(~B.can_out(F.col("bc"))).count() == 0


def test_carve_and_raise(nodes):
    sfd = flow.steepest(nodes.select("node", "z"), SPEC)
    low = values(depressions.carve(nodes, sfd), "carved")
    high = values(depressions.raise_to_receivers(nodes, sfd), "raised")
    for r in sfd.collect():
        assert low[r.rec] <= low[r.node] and high[r.rec] <= high[r.node]


def test_basins_and_rivers(nodes):
    sfd = flow.steepest(nodes.select("node", "z"), SPEC)
    b = A.basins(sfd)
    assert b.count() == SPEC.size and b.agg(F.max("basin")).first()[0] == sfd.filter("node = rec").count() - 1
    assert A.basin_boxes(b, SPEC).agg(F.sum("n")).first()[0] == SPEC.size
    area = A.accumulate_sfd(sfd)
    net = rivers.river_network(sfd, nodes, area, 3)
    assert net.count() == area.filter("value > 3").count()
    heads = rivers.river_heads(sfd, area, 3).count()
    assert net.select("river").distinct().count() == heads
    assert rivers.divides(sfd, nodes, SPEC).filter("basin is null").count() == 0


def test_closures_exclude_their_start(nodes):
    sfd = flow.steepest(nodes.select("node", "z"), SPEC)
    top = A.accumulate_sfd(sfd).orderBy(F.col("value").desc()).first()
    seed = nodes.filter(F.col("node") == top["node"]).select("node")
    up = A.upstream(A.as_edges(sfd), seed)
    assert up.count() == top["value"] - 1
    assert A.watershed(A.as_edges(sfd), seed).count() == top["value"]
    first = up.orderBy(F.col("step").desc()).first()
    path = A.flow_path(sfd, first["node"]).collect()
    assert len(path) >= first["step"] + 1


def test_distances(nodes):
    sfd = flow.steepest(nodes.select("node", "z"), SPEC).cache()
    rec = {r.node: (r.rec, r.dx) for r in sfd.collect()}
    out = values(A.distance_to_outlet(sfd))

    def down(n):
        return 0.0 if rec[n][0] == n else rec[n][1] + down(rec[n][0])

    assert out == pytest.approx({n: down(n) for n in rec})
    assert all(v >= 0 for v in values(A.distance_from_sources(sfd, True)).values())
    e = flow.downhill(nodes.drop("bc"), SPEC)
    near, far = values(A.mfd_distance(e, nodes, False, False)), values(A.mfd_distance(e, nodes, True, False))
    assert all(near[n] <= far[n] + 1e-9 for n in near)


def test_height_above_mask(nodes):
    sfd = flow.steepest(nodes.select("node", "z"), SPEC)
    mask = A.mask_by_area(A.accumulate_sfd(sfd), 4)
    out = A.height_above(sfd, nodes, mask)
    assert out.filter("target is not null and height < 0").count() == 0
    assert out.join(mask.filter("mask"), "node").filter("target <> node or height <> 0").count() == 0


def test_periodic_grid_has_no_sides(spark):
    ring = GridSpec(5, 4, periodic_ew=True, periodic_ns=True)
    n = grids.white_noise(spark, ring)
    assert [r[1] for r in neighbours(n, ring).groupBy("node").count().collect()] == [8] * 20


def test_links_bits_and_directions(nodes):
    table = links(nodes, SPEC)
    assert table.count() == sum(len(around(n)) for n in range(SPEC.size)) // 2
    e = flow.downhill(nodes, SPEC)
    back = neighbours_of_bits(bit_code(e), SPEC)
    assert back.select("node", "nb").exceptAll(e.select("node", "nb")).count() == 0 and back.count() == e.count()
    assert one_neighbour(nodes, SPEC, "left").filter("nb is null").count() == SPEC.ny
    assert orthogonal(e, SPEC).count() == e.count()
    parts = pair_by_angle(neighbours(nodes, SPEC), F.lit(0.3)).join(nodes.filter(B.can_give(F.col("bc"))), "node")
    assert all(abs(r[1] - 1) < 1e-9 for r in parts.groupBy("node").agg(F.sum("share")).collect())


def test_node_types(spark):
    spec = GridSpec(6, 5)
    n = grids.white_noise(spark, spec)
    for name in [*builder.PRESETS, "corners", "centre"]:
        out = builder.preset(n, spec, name)
        assert builder.validate(out, spec)["known"]
    closed = builder.preset(n, spec, "closed")
    assert not builder.validate(closed, spec)["drains"]
    eff = effective_neighbours(closed, spec)
    assert [r[1] for r in eff.groupBy("node").count().collect()] == [8] * 30
    flux = closed.filter("node = 0").select("node", "node_type", F.lit(0).alias("dir"), F.lit(2.0).alias("flux"))
    back = transfer_flow(flux, spec).first()
    assert back.target == 0 and back.flux == -2.0
    sea = builder.sea_level(builder.filled(n), spec, 5.3)
    assert builder.count_types(sea).agg(F.sum("n")).first()[0] == 30
    grown = builder.expand(builder.set_where(builder.filled(n), F.col("node") == 14, B.HAS_TO_OUT), spec, B.HAS_TO_OUT, 1)
    assert grown.filter(F.col("node_type") == B.HAS_TO_OUT).count() == 9
    assert builder.smooth(grown, spec).count() == 30
    assert builder.random_outlets(n, spec, 3).filter(F.col("node_type") == B.HAS_TO_OUT).count() == 3
    types = builder.count_types(n.withColumn("node_type", F.lit(6).cast("byte"))).first()
    assert types["name"] == "REFLECT"


def test_terrain_of_a_plane(spark):
    spec = GridSpec(8, 7)
    plane = spark.range(56).select(F.col("id").alias("node"), (F.col("id") % 8).cast("double").alias("z"))
    inner = [r * 8 + c for r in range(1, 6) for c in range(1, 7)]
    slope, curve, asp = values(terrain.slope(plane, spec), "slope"), values(terrain.curvature(plane, spec), "curvature"), values(terrain.aspect(plane, spec), "aspect")
    assert all(slope[n] == pytest.approx(45) and abs(curve[n]) < 1e-12 and asp[n] == pytest.approx(180) for n in inner)
    shade = values(terrain.hillshade(plane, spec), "shade")
    assert len({round(shade[n], 9) for n in inner}) == 1 and shade[0] == 0
    assert values(terrain.blur(plane, spec, 1), "z")[inner[5]] == pytest.approx(inner[5] % 8)
    shadow = values(terrain.cast_shadow(plane, spec, "right", 0.5), "shadow")
    assert not any(shadow.values())


def test_graph_algorithms(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 5.0), (4, 5, 1.0), (6, 6, 1.0)], "node long, nb long, dx double")
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert graphs.has_cycle(e) and not graphs.has_cycle(e.filter("node = 3 and nb = 4"))
    strong = {r.node: r.component for r in graphs.strong_components(e, n).collect()}
    assert strong == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    whole = {r.node: r.component for r in graphs.connected(e, n).collect()}
    assert whole == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}
    assert values(graphs.shortest_paths(e, 1)) == {1: 0, 2: 1, 3: 2, 4: 7, 5: 8}
    assert [r.node for r in graphs.shortest_path(e, 1, 5).orderBy("step").collect()] == [5, 4, 3, 2, 1]
    assert graphs.spanning_tree(e, "dx").agg(F.sum("dx")).first()[0] == 8.0
    rank = values(graphs.pagerank(e, n, rounds=50), "rank")
    assert sum(rank.values()) == pytest.approx(1)
    b = values(graphs.betweenness(e, n))
    assert b[3] == 5 and b[4] == 3 and b[7] == 0
    assert graphs.communities(e, n).count() == 7
    with pytest.raises(ValueError):
        levels(e, n)


def test_voxels(spark):
    cube = voxels.box(spark, (0, 0, 0), (3, 3, 3), 1.0)
    assert voxels.area_volume(cube).first()[0:2] == (64, 96)
    assert voxels.interior(cube).count() == 8 and voxels.surface(cube).count() == 56
    assert voxels.erode(cube).count() == 8 and voxels.dilate(cube, 2.0).count() == 64 + 96
    two = cube.unionAll(voxels.translate(cube, (10, 0, 0)))
    assert sorted(r.n for r in voxels.component_sizes(voxels.label(two)).collect()) == [64, 64]
    assert voxels.flood(two, spark.createDataFrame([(0, 0, 0)], "x long, y long, z long")).count() == 64
    assert voxels.put(cube, spark.createDataFrame([(0, 0, 0, 9.0)], "x long, y long, z long, value double")).agg(F.sum("value")).first()[0] == 72
    near = voxels.distance_to(cube, spark.createDataFrame([(0, 0, 0)], "x long, y long, z long"), 2)
    assert near.filter("distance = 0").count() == 1 and near.filter("x = 3").filter("distance is not null").count() == 0
    assert voxels.median(cube).filter("value <> 1").count() == 0 and voxels.gaussian(cube).filter("abs(value - 1) > 1e-9").count() == 0
    assert voxels.watershed(cube).select("basin").distinct().count() >= 1
    assert len(voxels.principal_axes(cube)) == 3 and voxels.skeleton(cube).count() > 0


def test_sources(spark, tmp_path, z):
    nodes = grids.from_array(spark, z)
    grids.write_npy(nodes, SPEC, str(tmp_path / "a.npy"))
    back = grids.read_npy(spark, str(tmp_path / "a.npy"))
    assert np.allclose(grids.to_array(back, SPEC).ravel(), z)
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 2\nnodata_value -1\n1 2 3\n4 -1 6\n")
    raster, spec = grids.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    assert spec.nx == 3 and {r.node: r.z for r in raster.collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 5: 6}
    for kind in ("fractal", "turbulence", "billow", "ridged"):
        surface = grids.noise_surface(spark, GridSpec(32, 32), kind=kind)
        a = {r.node: r.z for r in surface.collect()}
        assert len(a) == 1024 and a == {r.node: r.z for r in surface.repartition(3).collect()}
