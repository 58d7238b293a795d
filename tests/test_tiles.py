"""Propagation by tiles against the loops by level and a plain version, for tiles that paths cross many times."""

import random

import pytest
from pyspark.sql import functions as F

from talweg.functions.grid import GridSpec
from talweg.operators import tiles

SPEC = GridSpec(11, 9)


def graph(seed):
    """Edges between neighbours, from higher to lower numbers of a random order."""
    rng = random.Random(seed)
    order = list(range(SPEC.size))
    rng.shuffle(order)
    out = []
    for node in range(SPEC.size):
        r, c = divmod(node, SPEC.nx)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                nb = (r + dr) * SPEC.nx + c + dc
                if (dr or dc) and 0 <= r + dr < SPEC.ny and 0 <= c + dc < SPEC.nx and order[nb] < order[node] and rng.random() < 0.7:
                    out.append((node, nb, rng.random()))
    return out, sorted(range(SPEC.size), key=lambda k: -order[k])


def plain(edges, order, start, kind):
    value = dict(start)
    ends = {"sum": lambda a, b: a + b, "max": max, "min": min}[kind]
    for node in order:
        for a, b, w in edges:
            if a == node and value[a] is not None:
                sent = value[a] * w if kind == "sum" else value[a] + w
                value[b] = sent if value[b] is None else ends(value[b], sent)
    return value


@pytest.mark.parametrize("kind", ["sum", "max", "min"])
@pytest.mark.parametrize("tile", [1, 3, 64])
def test_tiles_equal_a_plain_walk(spark, kind, tile):
    edges, order = graph(tile)
    start = {k: float(k % 4) if kind == "sum" or k % 3 == 0 else None for k in order}
    e = spark.createDataFrame(edges, "node long, nb long, weight double")
    s = spark.createDataFrame(list(start.items()), "node long, value double")
    got = {r.node: r.value for r in tiles.propagate(e, s, SPEC, kind, F.col("weight"), tile).collect()}
    want = plain(edges, order, start, kind)
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()}


def test_upstream_and_a_cycle(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 13, 1.0)], "node long, nb long, weight double")
    nodes = spark.range(SPEC.size).select(F.col("id").alias("node"))
    got = {r.node: r.level for r in tiles.grid_levels(e, nodes, SPEC, 2).collect()}
    assert [got[k] for k in (0, 1, 2, 13, 20)] == [3, 2, 1, 0, 0]
    loop = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "node long, nb long, weight double")
    with pytest.raises(Exception, match="cycle"):
        tiles.grid_levels(loop, nodes, SPEC, 64).collect()
    none = tiles.propagate(e.limit(0), nodes.withColumn("value", F.lit(2.0)), SPEC)
    assert none.filter("value = 2").count() == SPEC.size
