"""Communities by gain of modularity: pairs and stars of communities merge, and the graph is contracted between levels.

Levels of a grid are done by tiles in a task each, with so much around them that what a tile's own communities do there
doesn't depend on more; then by larger tiles, as communities have become fewer. The last levels, where few links are left,
are done in one task. Without a grid, or between these, a level is a few joins and groupings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..scratch import cut, discard
from .iterate import to_root

#: Links from which on a level is a Spark job of its own; fewer are merged to the end in one task.
FEW_LINKS = 1 << 18
#: Side of the first tiles, how many nodes around one are looked at as well, and the levels that are done by them at most.
#: The next tiles are GROWTH times as wide, as long as they have no more than TILE_LINKS on average.
TILE, AROUND, LEVELS, GROWTH, TILE_LINKS = 512, 96, 6, 4, 1 << 21
#: What rows of a task tell: the community of a node, a link, the ends' weight of a community, figures of a level.
LABEL, LINK, SIZE, COUNTED, WITHIN, DONE = range(6)


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """a, b, w with a < b: links between two nodes in either direction as one, their weights summed (1 each by default);
    edges from a node to itself and those without a positive weight are left out."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = edges.select(F.least("node", "nb").alias("a"), F.greatest("node", "nb").alias("b"), w.alias("w")).filter("a < b and w > 0")
    return e.groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, modularity of labels (node, community) over links (a, b, w): the share of weight within communities less
    what it would be if ends met by chance. Null without links; a node without a label is a community of its own."""
    place = labels.select("node", "community")
    ends = links.select(F.col("a").alias("node"), "w").unionAll(links.select("b", "w")).groupBy("node").agg(F.sum("w").alias("k"))
    key = F.struct(F.when(F.col("community").isNull(), F.col("node")).alias("alone"), "community")
    sums = ends.join(place, "node", "left").groupBy(key.alias("key")).agg(F.sum("k").alias("k")).agg(F.sum("k").alias("total"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    both = links.join(place.toDF("a", "ca"), "a").join(place.toDF("b", "cb"), "b").filter("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("within"))
    return sums.crossJoin(both).select((2 * F.col("within") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))).alias("modularity"))


def _coin(c: Column, level: int) -> Column:
    """Heads or tails of a community at a level, evenly mixed."""
    x = F.pmod(c * F.lit(48271) + F.lit(7919 * (level + 1)), F.lit(2147483647).cast("long"))
    return F.pmod(F.floor(F.pmod(x * F.lit(69621), F.lit(2147483647).cast("long")) / F.lit(65536)), F.lit(2)) == 0


class _Graph(NamedTuple):
    """Communities in order of their ids with the weight of their ends and whether all that is known of them is whole; and
    links in order of (a, b), a < b, by places in ``ids``."""

    ids: np.ndarray
    k: np.ndarray
    known: np.ndarray
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray


def _beside(g: _Graph, flag: np.ndarray) -> np.ndarray:
    """Communities with the flag whose neighbours have it as well."""
    out = flag.copy()
    out[g.a[~flag[g.b]]] = False
    out[g.b[~flag[g.a]]] = False
    return out


def _merged(g: _Graph, total: float, level: int) -> tuple[_Graph, np.ndarray, np.ndarray]:
    """One level: the contracted graph, the new place of each community, and who had a neighbour to gain from. A
    community stays known if all that its merge, or its not merging, depends on is known."""
    n = len(g.ids)
    if not len(g.w):
        return g, np.arange(n), np.zeros(n, bool)
    gain = total * g.w - g.k[g.a] * g.k[g.b]
    use = np.flatnonzero(gain > 0)
    use = use[np.argsort(-gain[use], kind="stable")][::-1]  # the best comes last and stays
    best = np.full(n, -1)
    best[np.stack([g.a[use], g.b[use]], 1).ravel()] = np.repeat(use, 2)
    has, c = best >= 0, np.arange(n)
    to = np.where(has, g.a[best] + g.b[best] - c, c)
    x = (g.ids * 48271 + 7919 * (level + 1)) % 2147483647
    hub = has & np.where(to[to] == c, c < to, x * 69621 % 2147483647 // 65536 % 2 == 0)
    asks = np.flatnonzero(has & ~hub & hub[to])
    at, link = to[asks], best[asks]
    others = np.bincount(at, g.k[asks], n)
    order = np.lexsort((-asks, gain[link]))
    top = np.full(n, -1)
    top[at[order]] = asks[order]
    joins = (top[at] == asks) | (total * g.w[link] - g.k[asks] * (g.k[at] + others[at] - g.k[asks]) > 0)
    rep = c.copy()
    rep[asks[joins]] = at[joins]

    chose = _beside(g, g.known)
    role = chose & (~has | chose[to])
    asked = _beside(g, role)
    sure = role & np.where(hub, asked, ~has | (role[to] & (~hub[to] | asked[to])))
    left, place = np.unique(rep, return_inverse=True)
    known = np.ones(len(left), bool)
    known[place[~sure]] = False
    ends = np.sort(np.stack([place[g.a], place[g.b]]), 0)
    other = ends[0] < ends[1]
    pair, each = np.unique(ends[0][other] * len(left) + ends[1][other], return_inverse=True)
    w = np.bincount(each, g.w[other], len(pair))
    return _Graph(g.ids[left], np.bincount(place, g.k, len(left)), known, pair // len(left), pair % len(left), w), place, has


_ROWS = "kind byte, x long, y long, v double"


def _rows(kind: int, x: np.ndarray | list, y: np.ndarray | list, v: np.ndarray | list) -> pa.RecordBatch:
    x = np.asarray(x, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x), pa.array(np.asarray(y, np.int64)), pa.array(np.asarray(v, float))], names=["kind", "x", "y", "v"])


def _graph(a: np.ndarray, b: np.ndarray, w: np.ndarray, whole: Callable[[np.ndarray], np.ndarray]) -> _Graph:
    """The graph of links (a < b, each once); ``whole`` tells of which communities all links are here. A row with a = b is
    the weight of the ends in a community; without one it is that of its links."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    link, size = a != b, a == b
    k = np.bincount(a[link], w[link], len(ids)) + np.bincount(b[link], w[link], len(ids))
    k[a[size]] = w[size]
    order = np.flatnonzero(link)[np.lexsort((b[link], a[link]))]
    return _Graph(ids, k, whole(ids), a[order], b[order], w[order])


def _tile(g: _Graph, mine: np.ndarray, total: float, first: int, levels: int) -> Iterator[pa.RecordBatch]:
    """What a tile tells after so many levels: of its own communities what has become of them; of those named by them then
    their weight and links; and the figures of each level. DONE has the levels for which all of that is sure."""
    nodes, own, label, told = g.ids, mine, np.arange(len(g.ids)), []
    for level in range(levels + 1):
        if not (g.known[label[mine]].all() and _beside(g, g.known)[own].all()):
            yield _rows(DONE, [level - 1], [0], [0.0])
            return
        after, place, has = _merged(g, total, first + level)
        links = own[g.a]
        told += [_rows(COUNTED, [first + level], [own.sum()], [(g.k[own] ** 2).sum()]), _rows(WITHIN, [first + level], [has[own].sum()], [g.w[links].sum()])]
        if level < levels:
            g, label = after, place[label]
            own = mine[np.searchsorted(nodes, g.ids)]
    yield from told
    yield _rows(DONE, [levels], [0], [0.0])
    yield _rows(LABEL, nodes[mine], g.ids[label[mine]], np.zeros(mine.sum()))
    yield _rows(LINK, g.ids[g.a[links]], g.ids[g.b[links]], g.w[links])
    yield _rows(SIZE, g.ids[own], g.ids[own], g.k[own])


def _by_tiles(e: DataFrame, size: DataFrame | None, spec: GridSpec, total: float, first: int, levels: int, side: int, around: int) -> tuple[DataFrame, int]:
    """_ROWS of all tiles after so many levels from ``first`` on, or fewer if a tile needs more around it for that, and how
    many. A link goes to each tile that has one of its ends in it or around it; a community is where the node is that names it."""
    nx = spec.nx
    rows, columns = -(-spec.ny // side), -(-nx // side)

    def seen(count: int, at: Column) -> Column:
        near = lambda d: F.floor((at + F.lit(d)) / F.lit(side)).cast("long")
        return F.sequence(F.greatest(near(-around), F.lit(0).cast("long")), F.least(near(around), F.lit(count - 1).cast("long")))

    def tiles(end: str) -> Column:
        down, right = seen(rows, spec.row(F.col(end))), seen(columns, spec.col(F.col(end)))
        return F.flatten(F.transform(down, lambda i: F.transform(right, lambda j: i * columns + j)))

    if size is not None:
        e = e.select("a", "b", "w").unionAll(size.select("c", "c", "k"))
    sent = e.select(F.explode(F.array_union(tiles("a"), tiles("b"))).alias("tile"), "a", "b", "w")

    def solve(tile: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        top, left = tile // columns * side, tile % columns * side

        def within(ids: np.ndarray, more: int) -> np.ndarray:
            r, c = ids // nx - top, ids % nx - left
            return (r >= -more) & (r < side + more) & (c >= -more) & (c < side + more)

        g = _graph(a, b, w, lambda ids: within(ids, around))
        yield from _tile(g, within(g.ids, 0), total, first, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for batch in batches:
            tile, *columns_ = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and of != tile[i]:
                    yield from solve(of, *(np.concatenate(c) for c in zip(*held)))
                    held = []
                of = int(tile[i])
                held.append([c[i:j] for c in columns_])
        if held:
            yield from solve(of, *(np.concatenate(c) for c in zip(*held)))

    sent = sent.repartition(min(4 * rows * columns, 4096), "tile").sortWithinPartitions("tile")
    while True:
        told = cut(sent.mapInArrow(run, _ROWS))
        done = told.filter(F.col("kind") == DONE).agg(F.min("x")).first()[0]
        if done == levels:
            return told, done
        discard(told)
        levels = done


def _to_end(e: DataFrame, size: DataFrame, total: float, level: int, most: int) -> DataFrame:
    """_ROWS of the levels from one on until nobody gains, in one task: LABEL is the last community of one of ``size``.
    Figures are of communities that have links at first, but for those that others have joined."""
    ends = e.select(F.col("a").alias("c")).unionAll(e.select("b")).distinct()
    both = e.select("a", "b", "w").unionAll(size.join(ends, "c", "left_semi").select("c", "c", "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if not held:
            return
        g = _graph(*(np.concatenate(c) for c in zip(*held)), lambda ids: np.ones(len(ids), bool))
        first, label = g.ids, np.arange(len(g.ids))
        for at in range(level, most + 1):
            after, place, has = _merged(g, total, at)
            yield _rows(COUNTED, [at], [len(g.ids)], [(g.k**2).sum()])
            yield _rows(WITHIN, [at], [has.sum()], [g.w.sum()])
            if at == most or not has.any():
                break
            g, label = after, place[label]
        moved = first != g.ids[label]
        yield _rows(LABEL, first[moved], g.ids[label[moved]], np.zeros(moved.sum()))

    return cut(both.repartition(1).mapInArrow(run, _ROWS))


def _figures(told: DataFrame) -> list[tuple[int, int, int, float, float]]:
    """Level, communities, those with a neighbour to gain from, squares of their ends' weights, and the weight between them."""
    is_, both = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c))), told.filter(F.col("kind").isin(COUNTED, WITHIN))
    rows = both.groupBy("x").agg(is_(COUNTED, "y"), is_(WITHIN, "y"), is_(COUNTED, "v"), is_(WITHIN, "v")).collect()
    return sorted(tuple(r) for r in rows)


def communities(edges: DataFrame, nodes: DataFrame, weight: str | None = None, most: int = 200, spec: GridSpec | None = None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """node, community (its smallest node) of all nodes, and the number of communities that have links and the modularity
    at each level, from single nodes on.

    At a level each community looks for the neighbour with which merging gains most, 2m * w - k * k' (w: weight of the
    links between them, k: weight of the ends in each, 2m: of all ends), ties to the smaller pair. Of two that choose each
    other the smaller is a hub and the other joins it; of the rest a coin decides who may be a hub. Who has chosen a hub
    joins it if that gains even though all others who have chosen it join as well; the best of them joins in any case.
    So every merge of a level gains, whatever the others do, modularity rises from level to level, and there is a merge
    as long as any gains. The links are contracted then. Everything is an aggregate or an equi-join; a hub's many
    neighbours are combined before the shuffle. Nodes without links stay alone. ``most`` bounds the levels. With a grid
    levels go by tiles; where less than FEW_LINKS are left, the rest goes in one task. Neither changes a result.
    """
    e = cut(undirected(edges, weight))
    count, weights = e.agg(F.count(F.lit(1)), F.sum("w")).first()
    total = 2 * (weights or 0.0)
    history: list[tuple[int, float]] = []
    merges, start, level = [], None, 0
    score = lambda between, squares: 1 - 2 * between / total - squares / total / total
    size, side, around = None, TILE, AROUND
    while spec is not None and count >= FEW_LINKS and level < most and count <= TILE_LINKS * -(-spec.ny // side) * -(-spec.nx // side):
        alone = side >= max(spec.nx, spec.ny)  # a single tile has all around it, and needs one pass for many levels
        levels = min(8 * LEVELS if alone else LEVELS, most - level)
        told, done = _by_tiles(e, size, spec, total, level, levels, side, around)
        if done:
            figures = _figures(told)
            going = [r for r in figures if r[2]]
            history += [(r[1], score(r[4], r[3])) for r in going if r[0] < level + done]  # the level then at hand is told below
            label = told.filter(F.col("kind") == LABEL).selectExpr("x as c", "y as to")
            if start is None:
                start = label.toDF("node", "c")
            else:
                merges.append(label.filter("c <> to"))
            e = told.filter(F.col("kind") == LINK).selectExpr("x as a", "y as b", "v as w")
            size = told.filter(F.col("kind") == SIZE).selectExpr("x as c", "v as k")
            level, count = len(history), e.count()
            if len(going) < len(figures):
                break
        if done < levels:
            if alone:
                break
            side, around = side * GROWTH, around * GROWTH
    if size is None:
        ends = e.select(F.col("a").alias("c"), "w").unionAll(e.select("b", "w"))
        size = cut(ends.groupBy("c").agg(F.sum("w").alias("k")))
    for level in range(level, most + 1):
        n, squares = size.agg(F.count(F.lit(1)), F.sum(F.col("k") * F.col("k"))).first()
        if not n:
            break
        count, between = e.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if 0 < count < FEW_LINKS:
            told = _to_end(e, size, total, level, most)
            rows = _figures(told)
            history += [(n + r[1] - rows[0][1], score(r[4], squares + r[3] - rows[0][3])) for r in rows]
            merges.append(told.filter(F.col("kind") == LABEL).selectExpr("x as c", "y as to"))
            break
        history.append((n, score(between, squares)))
        if level == most:
            break
        pair = e.join(size.toDF("a", "ka"), "a").join(size.toDF("b", "kb"), "b").withColumn("gain", F.lit(total) * F.col("w") - F.col("ka") * F.col("kb")).filter("gain > 0")
        order = F.struct("gain", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), "w", "ka", "kb")
        seen = pair.select(F.col("a").alias("c"), order.alias("o")).unionAll(pair.select(F.col("b").alias("c"), order.alias("o")))
        best = seen.groupBy("c").agg(F.max("o").alias("o"))
        first = F.col("c") == -F.col("o.x")
        best = cut(best.select("c", F.when(first, -F.col("o.y")).otherwise(-F.col("o.x")).alias("to"), "o.gain", "o.w", F.when(first, F.col("o.ka")).otherwise(F.col("o.kb")).alias("k"), F.when(first, F.col("o.kb")).otherwise(F.col("o.ka")).alias("k_to")))
        if best.isEmpty():
            break
        mutual = F.col("back") == F.col("c")
        role = best.join(best.select(F.col("c").alias("to"), F.col("to").alias("back")), "to").withColumn("hub", F.when(mutual, F.col("c") < F.col("to")).otherwise(_coin(F.col("c"), level)))
        role = cut(role.drop("back"))
        asks = role.filter("not hub").join(role.filter("hub").select(F.col("c").alias("to")), "to", "left_semi")
        all_ = asks.groupBy("to").agg(F.sum("k").alias("others"), F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("top"))
        joins = asks.join(all_, "to").filter((F.col("c") == -F.col("top.c")) | (F.lit(total) * F.col("w") - F.col("k") * (F.col("k_to") + F.col("others") - F.col("k")) > 0))
        joins = cut(joins.select("c", "to"))
        merges.append(joins)
        for end in ("a", "b"):
            e = e.join(joins.toDF(end, "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        e = cut(undirected(e.select(F.col("a").alias("node"), F.col("b").alias("nb"), "w"), "w"))
        size = cut(size.join(joins, "c", "left").groupBy(F.coalesce("to", "c").alias("c")).agg(F.sum("k").alias("k")))
    place = nodes.select("node", F.col("node").alias("c")) if start is None else nodes.select("node").join(start, "node", "left").select("node", F.coalesce("c", "node").alias("c"))
    if merges:
        joined = merges[0]
        for m in merges[1:]:
            joined = joined.unionAll(m)
        every = joined.select(F.col("c").alias("node")).unionAll(joined.select("to")).distinct()
        tree = every.join(joined.toDF("node", "rec"), "node", "left").select("node", F.coalesce("rec", "node").alias("rec"), F.lit(0.0).alias("dx"))
        root = to_root(tree).select(F.col("node").alias("c"), "root")
        place = place.join(root, "c", "left").select("node", F.coalesce("root", "c").alias("c"))
    place = cut(place)
    name = place.groupBy("c").agg(F.min("node").alias("community"))
    return cut(place.join(name, "c").select("node", "community")), history
