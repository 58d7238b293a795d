"""Values along the edges of an acyclic grid graph by tiles: rounds grow with the tiles that a path crosses.

A tile is solved in one task, whatever the lengths of the paths in it. What it gives its neighbours is linear in what it
gets from them (over sums and products, or over extremes and sums), so a tile is reduced to a table from the nodes where
paths enter it to the nodes of other tiles where they go on. Only these tables are joined again and again; with all that
enters known, every tile is solved once more for its own nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..scratch import cut, discard


@dataclass(frozen=True)
class _Algebra:
    """How values meet (``ufunc``, ``agg``) and what stands for none; weights multiply for sums, else they are added."""

    name: str
    ufunc: np.ufunc
    agg: Callable[[str], Column]
    none: float
    unit: float

    def carry(self, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return value * weight if self.name == "sum" else value + weight


_ALGEBRAS = {
    "sum": _Algebra("sum", np.add, F.sum, 0.0, 1.0),
    "max": _Algebra("max", np.maximum, F.max, -np.inf, 0.0),
    "min": _Algebra("min", np.minimum, F.min, np.inf, 0.0),
}
#: Nodes where paths enter a tile that are followed at a time.
COLUMNS = 128
_TILE = "kind int, tile long, src long, dst long, w double, nodes binary, start binary, a binary, b binary, weights binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("tile", pa.int64()), ("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64()), *((c, pa.binary()) for c in ("nodes", "start", "a", "b", "weights"))])


def _steps(n: int, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Edges (a to b) in steps: those of a step start at nodes that all earlier steps have finished, in order of their end."""
    by_start = np.argsort(a, kind="stable")
    first = np.searchsorted(a[by_start], np.arange(n + 1))
    open_ = np.bincount(b, minlength=n)
    front, steps, seen = np.flatnonzero((open_ == 0) & (first[1:] > first[:-1])), [], 0
    while len(front):
        sizes = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        edges = by_start[at]
        edges = edges[np.argsort(b[edges], kind="stable")]
        steps.append(edges)
        seen += len(edges)
        ends, count = np.unique(b[edges], return_counts=True)
        open_[ends] -= count
        front = ends[(open_[ends] == 0) & (first[ends + 1] > first[ends])]
    if seen < len(a):
        raise ValueError("the edges have a cycle")
    return steps


def _meet(values: np.ndarray, ends: np.ndarray, algebra: _Algebra) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ends (given in order) and what meets at each."""
    at = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
    return ends[at], algebra.ufunc.reduceat(values, at, axis=0)


def _solved(value: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, steps: list[np.ndarray], algebra: _Algebra) -> np.ndarray:
    """Values (a row for each node) after all edges of a tile."""
    for e in steps:
        weight = w[e] if value.ndim == 1 else w[e][:, None]
        ends, got = _meet(algebra.carry(value[a[e]], weight), b[e], algebra)
        value[ends] = algebra.ufunc(value[ends], got)
    return value


def _reduce(algebra: _Algebra) -> Callable[[pa.Table], pa.Table]:
    """A tile's rows to: itself packed (kind 0), its table from entering nodes to other tiles' nodes (1), and what its own
    values send there (2). Rows: start values (0), edges (1), entering nodes (2)."""

    def run(table: pa.Table) -> pa.Table:
        kind, src, dst = (table[c].to_numpy() for c in ("kind", "src", "dst"))
        w = table["w"].fill_null(float("nan")).to_numpy()
        tile = table["tile"][0].as_py()
        nodes, at = np.unique(src[kind == 0], return_index=True)
        start = w[kind == 0][at]
        start = np.where(np.isnan(start), algebra.none, start)
        where = lambda x: np.minimum(np.searchsorted(nodes, x), max(len(nodes) - 1, 0))
        edge = kind == 1
        s, d, weight = src[edge], dst[edge], w[edge]
        inner = nodes[where(d)] == d if len(nodes) and len(d) else np.zeros(len(d), bool)
        a, b, wi = where(s[inner]), where(d[inner]), weight[inner]
        steps = _steps(len(nodes), a, b)
        none = [None] * 5
        out = [(0, tile, None, None, None, nodes.tobytes(), start.tobytes(), a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes(), wi.tobytes())]
        order = np.argsort(d[~inner], kind="stable")
        xa, xd, xw = where(s[~inner][order]), d[~inner][order], weight[~inner][order]
        batches = []
        if len(xd):
            own = _solved(start.copy(), a, b, wi, steps, algebra)
            ends, got = _meet(algebra.carry(own[xa], xw), xd, algebra)
            out += [(2, tile, None, e, v, *none) for e, v in zip(ends.tolist(), got.tolist()) if v != algebra.none]
            enter = np.unique(src[kind == 2])
            for k in range(0, len(enter), COLUMNS):
                some = enter[k : k + COLUMNS]
                value = np.full((len(nodes), len(some)), algebra.none)
                value[where(some), np.arange(len(some))] = algebra.unit
                value = _solved(value, a, b, wi, steps, algebra)
                ends, got = _meet(algebra.carry(value[xa], xw[:, None]), xd, algebra)
                i, j = np.nonzero(got != algebra.none)
                columns = [pa.array(np.full(len(i), 1, np.int32)), pa.array(np.full(len(i), tile)), pa.array(some[j]), pa.array(ends[i]), pa.array(got[i, j])]
                batches.append(pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(i), pa.binary())] * 5], schema=_SCHEMA))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA))
        return pa.Table.from_batches(batches)

    return run


def _finish(algebra: _Algebra) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes, value, w = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["start"]).copy(), np.frombuffer(row["weights"])
                a, b = np.frombuffer(row["a"], np.int32), np.frombuffer(row["b"], np.int32)
                for e in row["entered"] or ():
                    k = np.searchsorted(nodes, e["node"])
                    value[k] = algebra.ufunc(value[k], e["value"])
                value = _solved(value, a, b, w, _steps(len(nodes), a, b), algebra)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(value, mask=value == algebra.none if algebra.name != "sum" else None)], names=["node", "value"])

    return run


def propagate(edges: DataFrame, start: DataFrame, spec: GridSpec, kind: str = "sum", weight: Column | float = 1.0, tile: int = 128, downstream: bool = True) -> DataFrame:
    """node, value: each node's start value, met with what comes along the edges (node to nb; the other way without
    ``downstream``): sums of value times weight ("sum"), or the greatest or least value plus weight ("max", "min").

    ``start`` has every node once; a null value is none of its own (for sums 0). The edges must have no cycle: one within
    a tile raises, as does one over tiles once there have been more rounds than entering nodes. Tiles have ``tile`` times
    ``tile`` nodes; it changes no result but for the order in which floats are added.
    """
    algebra = _ALGEBRAS[kind]
    source, target = ("node", "nb") if downstream else ("nb", "node")

    def of(node: Column) -> Column:
        across = -(-spec.nx // tile)
        return (F.floor(spec.row(node) / tile) * across + F.floor(spec.col(node) / tile)).cast("long")

    e = edges.select(F.col(source).alias("src"), F.col(target).alias("dst"), (weight if isinstance(weight, Column) else F.lit(float(weight))).cast("double").alias("w"))
    rows = e.select(F.lit(1).alias("kind"), of(F.col("src")).alias("tile"), "src", "dst", "w")
    # an edge's far end is told to its tile if it is another one
    far = e.filter(of(F.col("src")) != of(F.col("dst"))).select(F.lit(2).alias("kind"), of(F.col("dst")).alias("tile"), F.col("dst").alias("src"), "dst", F.lit(None).cast("double").alias("w"))
    own = start.select(F.lit(0).alias("kind"), of(F.col("node")).alias("tile"), F.col("node").alias("src"), F.col("node").alias("dst"), F.col("value").cast("double").alias("w"))
    tiles = cut(rows.unionAll(far).unionAll(own).groupBy("tile").applyInArrow(_reduce(algebra), _TILE))
    table = tiles.filter("kind = 1").select("src", "dst", F.col("w").alias("t"))
    # several tiles may send to a node
    front = cut(tiles.filter("kind = 2").groupBy(F.col("dst").alias("node")).agg(algebra.agg("w").alias("value")))
    entered, rounds, most = front, 0, None
    carried = F.col("value") * F.col("t") if kind == "sum" else F.col("value") + F.col("t")
    while not front.isEmpty():
        rounds += 1
        if rounds % 64 == 0:
            most = table.select("dst").distinct().count() if most is None else most
            if rounds > most:
                raise ValueError("the edges have a cycle")
        sent = front.join(table, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), carried.alias("value")).groupBy("node").agg(algebra.agg("value").alias("value"))
        if kind == "sum":
            front = cut(sent)
            entered = entered.unionAll(front)
            if rounds % 16 == 0:
                entered = cut(entered.groupBy("node").agg(F.sum("value").alias("value")))
            continue
        both = cut(entered.withColumnRenamed("value", "old").join(sent, "node", "full"))
        better = F.col("value").isNotNull() & (F.col("old").isNull() | ((F.col("value") > F.col("old")) if kind == "max" else (F.col("value") < F.col("old"))))
        front = both.filter(better).select("node", "value")
        entered = both.select("node", (F.greatest if kind == "max" else F.least)("old", "value").alias("value"))
    entered = entered.groupBy("node").agg(algebra.agg("value").alias("value"))
    lists = entered.groupBy(of(F.col("node")).alias("tile")).agg(F.collect_list(F.struct("node", "value")).alias("entered"))  # a tile's rim at most
    packed = tiles.filter("kind = 0").select("tile", "nodes", "start", "a", "b", "weights").join(lists, "tile", "left")
    out = cut(packed.mapInArrow(_finish(algebra), "node long, value double"))
    discard(tiles)
    return out


def grid_levels(edges: DataFrame, nodes: DataFrame, spec: GridSpec, tile: int = 128) -> DataFrame:
    """node, level: length of the longest path to a node without receivers."""
    out = propagate(edges, nodes.select("node", F.lit(0.0).alias("value")), spec, "max", 1.0, tile, downstream=False)
    return out.select("node", F.col("value").cast("long").alias("level"))
