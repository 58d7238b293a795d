"""Depth-first order of forests and ranges of it, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from talweg.operators import ranges


def forest(spark, rec):
    rows = [(node, to, 0.0 if node == to else 1.0) for node, to in rec.items()]
    return spark.createDataFrame(rows, "node long, rec long, dx double")


def plain(rec):
    """Node to (root, at, size, depth, post) by recursion."""
    donors = {}
    for node, to in sorted(rec.items()):
        if node != to:
            donors.setdefault(to, []).append(node)
    out, count, done = {}, 0, 0

    def visit(node, root, depth):
        nonlocal count, done
        at, count = count, count + 1
        for d in donors.get(node, []):
            visit(d, root, depth + 1)
        out[node] = (root, at, count - at, depth, done)
        done += 1

    for node in sorted(n for n, to in rec.items() if n == to):
        visit(node, node, 0)
    return out


def shapes():
    rng = random.Random(4)
    wide = {n: (n if n % 50 == 0 else rng.choice([m for m in range(max(0, n - 30), n)])) for n in range(300)}
    far = {n * 70_000: (n - n % 3) * 70_000 for n in range(30)}  # roots in many blocks
    return {"random": wide, "path": {n: max(0, n - 1) for n in range(120)}, "star": {n: 7 for n in range(60)}, "blocks": far, "single": {5: 5}}


@pytest.mark.parametrize("name", shapes())
def test_depth_first(spark, name):
    rec = shapes()[name]
    got = {r.node: (r.root, r["at"], r["size"], r.depth, r.post) for r in ranges.depth_first(forest(spark, rec)).collect()}
    assert got == plain(rec)


def test_upstream_in(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 16)  # ranges over many blocks, ends carried from one to the next
    rec = shapes()["random"]
    order = ranges.depth_first(forest(spark, rec)).cache()
    for starts in ([0], [299], [50, 51, 60, 60, 100, 9999], list(range(0, 300, 7)), []):
        df = spark.createDataFrame([(s,) for s in starts], "node long")
        above = set()
        for node in rec:
            at = node
            while rec[at] != at:
                at = rec[at]
                if at in starts:
                    above.add(node)
        got = [r.node for r in ranges.upstream_in(order, df).collect()]
        assert sorted(got) == sorted(above)
        own = [r.node for r in ranges.upstream_in(order, df, include_self=True).collect()]
        assert sorted(own) == sorted(above | (set(starts) & set(rec)))


def test_no_nodes(spark):
    none = forest(spark, {5: 5}).filter(F.col("node") < 0)
    assert ranges.upstream_in(ranges.depth_first(none), none).count() == 0
