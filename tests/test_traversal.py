"""Orders, labels and streams."""

import pytest
from pyspark.sql import functions as F

from talweg.functions.grid import GridSpec
from talweg.functions.vectors import curvature_radius, normalised, unit
from talweg.operators import depressions, flow, traversal
from talweg.operators.accumulate import as_edges
from talweg.sources import grids
from talweg.streaming import surface

SPEC = GridSpec(9, 7)


@pytest.fixture(scope="module")
def nodes(spark):
    return grids.white_noise(spark, SPEC, seed=9).cache()


def test_spiral_visits_all(nodes):
    at = sorted((r.at, r.node) for r in traversal.spiral(nodes, SPEC).collect())
    assert [a for a, _ in at] == list(range(SPEC.size))
    assert [n for _, n in at[:10]] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 17]
    steps = [abs(a // 9 - b // 9) + abs(a % 9 - b % 9) for (_, a), (_, b) in zip(at, at[1:])]
    assert set(steps) == {1}


def test_orders_and_subgraphs(nodes):
    sfd = flow.steepest(nodes, SPEC).cache()
    order = traversal.sfd_order(sfd)
    assert traversal.order_is_valid(order, as_edges(sfd))
    assert not traversal.order_is_valid(order.withColumn("level", -F.col("level")), as_edges(sfd))
    high = nodes.orderBy(F.col("z").desc()).limit(2).select("node")
    lv, e = traversal.subgraph(flow.downhill(nodes, SPEC), high)
    assert lv.join(high, "node").count() == 2 and traversal.order_is_valid(lv, e)
    assert traversal.breadth_first(nodes, SPEC, 0).count() == SPEC.size
    assert traversal.random_neighbour(nodes, SPEC).count() == SPEC.size
    assert traversal.random_node(nodes).count() == 1
    walk = traversal.random_walk(flow.downhill(nodes, SPEC), high, 3)
    assert walk.filter("step = 0").count() == 2


def test_oceans_and_depressions(nodes):
    sea = traversal.label_ocean(nodes, SPEC, 5.5).join(nodes, "node")
    assert sea.filter("ocean and z > 5.5").count() == 0
    filled = depressions.fill(nodes, SPEC)
    d = traversal.label_depressions(filled, SPEC)
    assert d.filter("depression is not null").count() == filled.filter("filled > z").count()


def test_vectors(spark):
    df = spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "x double, y double")
    u = df.select(*[c.alias(n) for c, n in zip(unit(F.col("x"), F.col("y")), "uv")]).collect()
    assert (u[0].u, u[0].v, u[1].u) == (0.6, 0.8, 0.0)
    circle = df.select(curvature_radius(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0)).alias("r")).first()
    assert circle.r == pytest.approx(1.0)
    assert sorted(r.x for r in normalised(df, "x").collect()) == [0.0, 1.0]


def test_stream(spark, tmp_path):
    rows = [(k % 4, f"2024-01-0{1 + k // 4} 00:00:00", 0, "a", float(k), "{}") for k in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    for k in range(3):
        df.filter(F.col("ts").startswith(f"2024-01-0{k + 1}")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = surface.measurements(spark, str(tmp_path / "in"))
    q = surface.running_surface(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {r.node: r.z for r in spark.table("running").collect()} == {0: 4.0, 1: 5.0, 2: 6.0, 3: 7.0}
    w = surface.windowed_rows(surface.measurements(spark, str(tmp_path / "in")), 1000).writeStream.outputMode("append").format("memory").queryName("windows").start()
    w.processAllAvailable()
    w.stop()
    assert all(r.n == 4 for r in spark.table("windows").collect())
