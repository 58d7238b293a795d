"""Simulations, registered queries and their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from talweg.functions.grid import GridSpec
from talweg.operators import accumulate as A
from talweg.operators import builder, flow
from talweg.plans import flood, landscape
from talweg.plans.queries import QUERIES, SQL
from talweg.sources import grids

SPEC = GridSpec(8, 7, 30.0, 30.0)
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def nodes(spark):
    return builder.codes(grids.white_noise(spark, SPEC, seed=3), SPEC).cache()


def test_steady_stream_power_drains_everywhere(nodes):
    out = landscape.steady_stream_power(nodes, SPEC, rounds=2).cache()
    sfd = flow.steepest(out, SPEC)
    assert flow.pits(sfd, out).count() == 0
    assert out.agg(F.min("z")).first()[0] > 0


def test_implicit_incision_lowers_and_keeps_order(nodes):
    wet = landscape.drained(nodes, SPEC)
    sfd = flow.steepest(wet, SPEC).cache()
    area = A.accumulate_sfd(sfd, constant=SPEC.cell_area)
    new = landscape.implicit_incision(wet, sfd, area, 1e4, landscape.StreamPower(k=1e-4, n=1.2))
    both = new.join(wet, "node")
    assert both.filter("value > z + 1e-9").count() == 0
    rec = sfd.filter("node <> rec").join(new, "node").join(new.selectExpr("node as rec", "value as v2"), "rec")
    assert rec.filter("value < v2 - 1e-9").count() == 0


def test_fluxes_conserve_or_bound_sediment(nodes):
    wet = landscape.drained(nodes, SPEC)
    for mode in ("full", "no_critical", "deposition_only", "long"):
        out = landscape.hillslope_fluxes(wet, SPEC, mode=mode)
        s = out.agg(F.sum("erosion"), F.sum("deposition"), F.min("deposition")).first()
        assert s[1] <= s[0] + 1e-9 and s[2] >= 0
    out = landscape.davy_lague(wet, SPEC).agg(F.sum("erosion"), F.sum("deposition")).first()
    assert 0 <= out[1] <= out[0]
    evolved = landscape.evolve(nodes, SPEC, [lambda n, s: landscape.hillslope_fluxes(n, s)], 10.0, 1, 1e-3)
    assert evolved.count() == SPEC.size
    assert landscape.landslides(wet, SPEC, 1e3, 20.0).count() == SPEC.size
    fine, spec = landscape.refined(nodes, SPEC, 0.1, smooth=True)
    assert spec.size == 4 * SPEC.size and fine.count() == spec.size


def test_strata(spark):
    n = spark.createDataFrame([(0, [(1.0, 10.0)]), (1, [])], "node long, strata array<struct<thickness double, prop double>>")
    more = landscape.deposit(n, F.lit(0.5), F.lit(40.0), 2.0)
    piles = {r.node: [tuple(s) for s in r.strata] for r in more.collect()}
    assert piles[0] == [(1.5, 20.0)] and piles[1] == [(0.5, 40.0)]
    less = {r.node: [tuple(s) for s in r.strata] for r in landscape.strip(more, F.lit(1.0)).collect()}
    assert less[0] == [(0.5, 20.0)] and less[1] == []
    assert landscape.core(landscape.aged(more, 5.0), 0).first()["prop"] == 25.0


def test_inertial_flow_keeps_water(nodes):
    wet = nodes.select("node", (F.col("z") * 0).alias("z"), F.when(F.col("node") == 20, 1.0).otherwise(0.1).alias("h"))
    links, total = None, wet.agg(F.sum("h")).first()[0]
    for _ in range(3):
        wet, links = flood.inertial_step(wet, links, SPEC, 0.5)
    assert wet.agg(F.sum("h")).first()[0] == pytest.approx(total)
    assert 0 < flood.courant_dt(wet, SPEC) <= 10


def test_steady_flooding(nodes):
    wet = landscape.drained(nodes, SPEC).withColumn("h", F.lit(0.01))
    out = flood.steady_step(wet, SPEC, 1e-5, 1.0).cache()
    inner = out.filter("bc = 1")
    assert inner.filter("h < 0 or q_in <= 0").count() == 0
    assert flood.convergence(out).first()["depth"] > 0
    water = out.withColumn("z", F.col("z") + F.col("h"))
    e = flow.downhill(water, SPEC)
    assert flood.metrics(out, e, SPEC).count() == SPEC.size and flood.shear_erosion(out, e).filter("erosion < 0").count() == 0
    gain = flood.lateral_transfer(e, out, SPEC, 0.1).agg(F.sum("gain")).first()[0]
    assert abs(gain or 0.0) < 1e-9
    assert flood.particles(out, SPEC, 20, 1.0).filter("h < 0").count() == 0
    assert flood.droplet_erosion(nodes, SPEC, 50, tile=5).count() == SPEC.size


CHECKED = ["d8_neighbours", "drainage_area_mfd", "topological_level", "draining_fill", "depression_hierarchy", "rerouted_receivers_fill", "link_table", "steepest_receiver", "mfd_edges_seibert", "drainage_area_tilted", "min_distance_from_sources_sfd", "basin_bbox", "river_nodes", "hillshade", "aspect", "degree_entropy", "pagerank_5", "voxel_components", "inertial_flood_step", "stream_power_step", "chi_coordinate", "shortest_path_lengths", "filled_surface", "boundary_predicates", "boundary_presets", "orthogonal_cells", "rain_discharge", "height_above_drainage", "smoothed_types", "inertial_flood_with_flux", "voxel_bilateral", "voxel_closing", "shortest_route_by_landmarks", "voxel_objects", "voxel_convex_hull"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-6)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_numbers_of_nodes_match_the_grid(spark):
    n, spec = grids.events_surface(spark, SF)
    assert spec.size == n.count() == np.int64(1000)


def test_the_traced_path_has_no_limit_of_its_own(nodes, monkeypatch):
    from talweg.plans.queries import to_root, trace_flow_path

    monkeypatch.setattr(A.flow_path, "__defaults__", (1,))  # instead of a path of over 1,000 steps
    longest = to_root(flow.steepest(nodes, SPEC)).agg(F.max("hops")).first()[0]
    assert longest > 1 and trace_flow_path(nodes, SPEC).agg(F.max("step")).first()[0] == longest
