"""Depression hierarchy: the tree in which depressions merge as water rises, with spill levels and volumes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import D8, GridSpec
from ..scratch import cut
from . import spanning
from .components import components
from .depressions import basin_passes, open_roots, spill_levels
from .iterate import to_root

#: Basins that a task gets at about (those of one top depression stay together), and those whose cells it gets at most, about.
BASINS, CELLED = 1 << 15, 1 << 18
_TREE = pa.schema([("bucket", pa.int64()), ("i", pa.int64()), ("up", pa.int64()), ("label", pa.int64()), ("n_basins", pa.int64()), ("formed", pa.float64()), ("spill", pa.float64()), ("parent_label", pa.int64()), ("parent_basins", pa.int64())])
_SUMS = pa.schema([("label", pa.int64()), ("n_basins", pa.int64()), ("n_cells", pa.int64()), ("volume", pa.float64())])


def _merged(table: pa.Table) -> pa.Table:
    """The trees of a bucket's top depressions from its basins (b1, spill) and the passes at which they merge (b1, b2,
    pass_z), lowest first. Basins come first, by number, and parts before what they merge to."""
    b1, b2, spill, pass_z = (table[c].to_numpy() for c in ("b1", "b2", "spill", "pass_z"))
    leaf = table["b2"].is_null().to_numpy()
    order = np.argsort(b1[leaf])
    basins, n = b1[leaf][order], int(leaf.sum())
    ends = [np.searchsorted(basins, b[~leaf].astype(np.int64)) for b in (b1, b2)]
    by = np.lexsort((ends[1], ends[0], pass_z[~leaf]))
    label, size, formed = basins.tolist(), [1] * n, [math.nan] * n
    level, up = spill[leaf][order].tolist(), [-1] * n
    over = list(range(n))  # leads from a basin to the depression that it is in so far

    for x, y, z in zip(ends[0][by].tolist(), ends[1][by].tolist(), pass_z[~leaf][by].tolist()):
        while over[x] != x:
            over[x] = x = over[over[x]]
        while over[y] != y:
            over[y] = y = over[over[y]]
        if x == y:
            continue
        k = len(label)
        label.append(min(label[x], label[y]))
        size.append(size[x] + size[y])
        formed.append(z)
        level.append(level[x])  # of the top, until they merge
        up.append(-1)
        over.append(k)
        level[x] = level[y] = z
        up[x] = up[y] = over[x] = over[y] = k
    up_, label_, size_ = np.array(up, np.int64), np.array(label, np.int64), np.array(size, np.int64)
    none = up_ < 0
    columns = [np.full(len(up), table["bucket"][0].as_py()), np.arange(len(up)), up_, label_, size_, formed, level, label_[up_], size_[up_]]
    masks = [None] * 5 + [np.arange(len(up)) < n, None, none, none]
    return pa.table([pa.array(np.asarray(c), f.type, mask=m) for c, f, m in zip(columns, _TREE, masks)], schema=_TREE)


def _covered(cells: pa.Table, tree: pa.Table) -> pa.Table:
    """For each depression of a bucket its cells below the spill level and the water over them, of the cells given."""
    tree = tree.sort_by("i")
    up, label, size, level = (tree[c].to_numpy() for c in ("up", "label", "n_basins", "spill"))
    up = np.where(up < 0, np.arange(len(up)), up)
    at = np.searchsorted(label[size == 1], cells["root"].to_numpy())
    z = cells["z"].to_numpy()
    jumps = [up]
    while not np.array_equal(twice := jumps[-1][jumps[-1]], jumps[-1]):
        jumps.append(twice)
    for far in reversed(jumps):  # up to the last depression that doesn't cover the cell, levels rise on the way
        at = np.where(level[far[at]] <= z, far[at], at)
    at = np.where(level[at] <= z, up[at], at)
    n, water = np.bincount(at, minlength=len(up)).tolist(), np.bincount(at, level[at] - z, len(up)).tolist()
    for i, (p, low, high) in enumerate(zip(up.tolist(), level.tolist(), level[up].tolist())):
        if p != i and n[i]:
            n[p] += n[i]
            water[p] += water[i] + n[i] * (high - low)
    n, water = np.array(n), np.array(water)
    wet = n > 0
    return pa.table([pa.array(c[wet]) for c in (label, size, n, water)], schema=_SUMS)


def hierarchy(nodes: DataFrame, sfd: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8) -> DataFrame:
    """label, n_basins, formed, spill, parent_label, parent_basins, n_cells, volume: a row for each depression.

    A basin (by root) without a way out is a depression; as water rises, two depressions whose lowest pass lies below the
    level at which they spill out of the model merge to one, which is their parent: the passes in order of height, then
    root (Kruskal's order, kept as a tree). ``label`` is the smallest root in a depression, which with ``n_basins`` names
    it; ``formed`` is the pass at which its parts met (null for a basin), ``spill`` where it meets its sibling or, at the
    top, spills out. ``n_cells`` and ``volume``: its cells below the spill level and the water over them.

    Depressions of different tops have nothing to do with one another, so tops are dealt out whole, many to a task (a few
    numbers for each basin). Only passes of their minimum spanning forest, found by tiles, take part. A cell counts at the
    first of its depressions that covers it, which is found over pointers doubled in the task; sums over subtrees do the
    rest. The cells of a large top go to several tasks, each with the tree. Basins that never spill are left out.
    """
    root = cut(to_root(sfd).select("node", "root"))
    passes = cut(basin_passes(nodes, sfd, spec, around).withColumn("pass_z", F.col("pass_z").cast("double")))
    spill = spill_levels(passes, open_roots(nodes, sfd), spec).filter("spill is not null")
    spill = cut(spill.select(F.col("root").alias("b"), F.col("spill").cast("double").alias("spill")))
    inner = passes.join(spill.select(F.col("b").alias("b1"), F.col("spill").alias("s1")), "b1").join(spill.select(F.col("b").alias("b2"), F.col("spill").alias("s2")), "b2")
    inner = inner.filter("pass_z < least(s1, s2)").select(F.col("b1").alias("u"), F.col("b2").alias("v"), F.col("pass_z").alias("w"), F.col("b1").alias("k1"), F.col("b2").alias("k2"))
    merges = cut(spanning.certain(spanning.forest(inner, spec)).select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("w").alias("pass_z")))
    tops = components(merges.selectExpr("b1 as u", "b2 as v"))
    buckets = max(1, -(-spill.count() // BASINS))
    own = spill.join(tops, F.col("b") == F.col("node"), "left").select(F.pmod(F.xxhash64(F.coalesce("component", "b")), F.lit(buckets)).alias("bucket"), F.col("b").alias("b1"), F.lit(None).cast("long").alias("b2"), F.lit(None).cast("double").alias("pass_z"), "spill")
    own = cut(own)
    links = merges.join(own.select("bucket", "b1"), "b1").select("bucket", "b1", "b2", "pass_z", F.lit(None).cast("double").alias("spill"))
    tree = cut(own.unionByName(links).groupBy("bucket").applyInArrow(_merged, "bucket long, i long, up long, label long, n_basins long, formed double, spill double, parent_label long, parent_basins long"))
    parts = F.broadcast(own.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CELLED).alias("parts")))
    basin = own.join(parts, "bucket").select("bucket", F.col("b1").alias("root"), F.pmod(F.xxhash64("b1", F.lit(1)), "parts").alias("part"), "spill")
    cells = nodes.select("node", F.col("z").cast("double").alias("z")).join(root, "node").join(basin, "root").filter("z < spill").select("bucket", "part", "root", "z")
    trees = tree.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    trees = trees.select("bucket", "part", "i", "up", "label", "n_basins", "spill")
    found = cells.groupBy("bucket", "part").cogroup(trees.groupBy("bucket", "part")).applyInArrow(_covered, "label long, n_basins long, n_cells long, volume double")
    whole = found.groupBy("label", "n_basins").agg(F.sum("n_cells").alias("n_cells"), F.sum("volume").alias("volume"))
    out = tree.drop("bucket", "i", "up").join(whole, ["label", "n_basins"], "left")
    volume = F.coalesce("volume", F.lit(0.0)) * F.lit(spec.cell_area)
    return out.select("label", "n_basins", "formed", "spill", "parent_label", "parent_basins", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), volume.alias("volume"))
