"""Hard negatives against a plain version: ties, nulls, repeated rows, huge components, blocks of a few rows."""

import math
import random

import numpy as np
import pytest

from talweg.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, u long, a int, rank string"


def plain(rows, cfg):
    seen = {}
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(max(-(2**63), min(2**63 - 1, math.floor(float(np.float32(x)) * 256))) for x in v)
        seen[vec_id, label, q] = True
    rows, out = list(seen), []
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for a in rows:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-clip(sum(x * y for x, y in zip(a[2], b[2]))), b[0] is None, b[0] or 0, b[1], b) for b in rows if b is not a), key=lambda x: x[:3])
        for p in [x for x in scored if x[3] == a[1]][: cfg.positives]:
            fit = [x for x in scored if x[3] != a[1] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            out += [(a[0], p[4][0], k + 1, x[4][0], -p[0], -x[0]) for k, x in enumerate(fit[: cfg.negatives])]
    return sorted(out, key=str)


def mined(spark, rows, cfg):
    df = spark.createDataFrame(rows, SCHEMA)
    out = negatives.hard_negatives(df.select("vec_id", "label", negatives.quantised(df, "embedding").alias("v")), cfg).collect()
    return sorted((tuple(r) for r in out), key=str)


def make(seed, n, dims=8, spread=3):
    rng = random.Random(seed)
    return [(k, [rng.randrange(-spread, spread + 1) / 4 for _ in range(dims)], rng.randrange(3), k, 1, "r") for k in range(n)]


@pytest.mark.parametrize("cfg", [negatives.NegativeConfig(), negatives.NegativeConfig(anchors=2, rows=37, sorted=1)])
def test_ties_and_edges(spark, cfg):
    rows = make(1, 420)
    rows += [(600, None, 1, 0, 1, "r"), (700, [0.5] * 8, None, 0, 1, "r"), (800, [float("nan")] + [0.1] * 7, 1, 0, 1, "r"), (801, [float("inf")] * 8, 1, 0, 1, "r"), (802, [None] * 8, 2, 0, 1, "r")]
    rows += [(None, [0.75] * 8, 1, 0, 1, "r"), rows[100], rows[100], rows[5], (900, [], 1, 0, 1, "r"), (901, [0.75] * 3, 2, 0, 1, "r"), (-100, [0.75] * 8, 1, 0, 1, "r")]
    rows += [(k, [0.5] * 8, k % 2, 0, 1, "r") for k in range(1000, 1100)]  # one vector many times
    got = mined(spark, rows, cfg)
    assert got == plain(rows, cfg) and len(got) > 50


def test_components_beyond_floating_point(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([1e30, 3e12, -2e9, 0.1, 7e7]) for _ in range(3)], k % 3, 0, 1, "r") for k in range(60)] + [(100, [3e12, 2e9, 0.1], 0, 0, 1, "r"), (200, [7e7, 0.1, 7e7], 1, 0, 1, "r")]
    cfg = negatives.NegativeConfig(rows=16)
    assert mined(spark, rows, cfg) == plain(rows, cfg)


def test_nothing_to_mine(spark):
    cfg = negatives.NegativeConfig()
    assert mined(spark, [], cfg) == []
    assert mined(spark, make(3, 90)[1:], cfg) == []  # no anchor
    assert mined(spark, [(0, [1.0], 1, 0, 1, "r")], cfg) == []
