"""Graph algorithms over edge tables: rank, shortest paths, spanning trees, communities, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..scratch import cut
from . import spanning
from .components import components
from .iterate import reach, relax
from .parts import least, tile_of


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").join(edges.select(F.col("nb").alias("node")), "node", "left_anti")


def sink_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").join(edges.select("node"), "node", "left_anti")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and largest out-degree, sources, sinks, mean and largest slope."""
    d = nodes.select("node").join(edges.groupBy("node").agg(F.count(F.lit(1)).alias("out")), "node", "left")
    d = d.join(edges.groupBy(F.col("nb").alias("node")).agg(F.count(F.lit(1)).alias("in")), "node", "left").select(F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("in", F.lit(0)).alias("in"))
    a = d.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("out").alias("n_edges"), F.avg("out").alias("mean_degree"), F.max("out").alias("max_degree"), F.count(F.when(F.col("in") == 0, 1)).alias("n_sources"), F.count(F.when(F.col("out") == 0, 1)).alias("n_sinks"))
    return a.crossJoin(F.broadcast(edges.agg(F.avg("slope").alias("mean_slope"), F.max("slope").alias("max_slope"))))


def degree_entropy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, entropy: Shannon entropy (bits) of the distribution of out-degrees."""
    d = nodes.select("node").join(edges.groupBy("node").agg(F.count(F.lit(1)).alias("k")), "node", "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("t")
    return d.crossJoin(F.broadcast(d.agg(F.sum("n").alias("t")))).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component of all nodes, links taken both ways; a lone node is its own."""
    c = components(edges.select(F.col("node").alias("u"), F.col("nb").alias("v")))
    return nodes.select("node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def are_connected(edges: DataFrame, a: int, b: int) -> bool:
    both = edges.select("node", "nb").unionAll(edges.select(F.col("nb").alias("node"), F.col("node").alias("nb")))
    seed = edges.sparkSession.createDataFrame([(a,)], "node long")
    return a == b or not reach(both, seed).filter(F.col("node") == b).isEmpty()


def has_cycle(edges: DataFrame) -> bool:
    """Whether directed edges have a cycle: nodes without receivers are taken away until none is left or none goes."""
    e = cut(edges.select("node", "nb").distinct())
    n = e.count()
    while n:
        e = cut(e.join(e.select(F.col("node").alias("nb")).distinct(), "nb", "left_semi").select("node", "nb"))
        left = e.count()
        if left == n:
            return True
        n = left
    return False


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (smallest node) of strongly connected components: colours spread forward, then the
    nodes of a colour that reach its root are one component; the others go another round."""
    e = cut(edges.select("node", "nb").filter("node <> nb").distinct())
    open_ = cut(nodes.select("node").distinct())
    done = None
    while not open_.isEmpty():
        colour = relax(e, open_.select("node", F.col("node").alias("value")), F.col("value"))
        c2 = colour.select(F.col("node").alias("nb"), F.col("value").alias("value2"))
        back = e.join(colour, "node").join(c2, "nb").filter("value = value2").select(F.col("nb").alias("node"), F.col("node").alias("nb"))
        found = reach(back, colour.filter("node = value").select("node")).select("node").join(colour, "node").select("node", F.col("value").alias("component"))
        found = cut(found)
        done = found if done is None else done.unionAll(found)
        open_ = cut(open_.join(found.select("node"), "node", "left_anti"))
        e = cut(e.join(open_, "node", "left_semi").join(open_.select(F.col("node").alias("nb")), "nb", "left_semi").select("node", "nb"))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def shortest_paths(edges: DataFrame, start: int, weight: str = "dx", spec: GridSpec | None = None) -> DataFrame:
    """node, value: the length of the shortest way from one node along edges with weights not below 0. With a grid by tiles,
    else a round for each step."""
    seed = edges.sparkSession.createDataFrame([(start, 0.0)], "node long, value double")
    if spec is not None:
        return least(edges, seed, lambda n: tile_of(n, spec), F.col(weight))
    return relax(edges.select("node", "nb", F.col(weight).cast("double").alias("w")), seed, F.col("value") + F.col("w"))


def shortest_path(edges: DataFrame, start: int, goal: int, weight: str = "dx") -> DataFrame:
    """step (from the goal back), node of a shortest path; ties go to the smallest node. Empty if there is none."""
    d = cut(shortest_paths(edges, start, weight))
    if d.filter(F.col("node") == goal).isEmpty():
        return edges.sparkSession.createDataFrame([], "step long, node long")
    e = edges.select("node", "nb", F.col(weight).cast("double").alias("w")).join(d.withColumnRenamed("value", "d1"), "node").join(d.selectExpr("node as nb", "value as d2"), "nb")
    tight = e.filter((F.abs(F.col("d1") + F.col("w") - F.col("d2")) <= 1e-9 * (1 + F.abs("d2"))) & ((F.col("d1") < F.col("d2")) | (F.col("node") < F.col("nb"))))
    parent = tight.groupBy(F.col("nb").alias("node")).agg(F.min_by("node", F.struct("d1", "node")).alias("nb")).filter(F.col("node") != start)
    seed = edges.sparkSession.createDataFrame([(goal,)], "node long")
    return reach(parent, seed).select(F.col("step").cast("long").alias("step"), "node")


def spanning_tree(edges: DataFrame, weight: str = "w", spec: GridSpec | None = None) -> DataFrame:
    """a, b, weight of a minimum spanning forest. With a grid by nested tiles, else by Boruvka: each component takes its
    lightest link in a round.

    Ties go to the smallest pair, so the links have one order and no round makes a cycle."""
    if spec is not None:
        a, b = F.least("node", "nb"), F.greatest("node", "nb")
        found = spanning.certain(spanning.forest(edges.select(a.alias("u"), b.alias("v"), F.col(weight).alias("w"), a.alias("k1"), b.alias("k2")), spec))
        return found.select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("w").alias(weight))
    e = cut(edges.select(F.least("node", "nb").alias("a"), F.greatest("node", "nb").alias("b"), F.col(weight).alias("w")).filter("a < b").groupBy("a", "b").agg(F.min("w").alias("w")))
    label = cut(e.select(F.col("a").alias("node")).unionAll(e.select("b")).distinct().withColumn("l", F.col("node")))
    tree = None
    while True:
        x = e.join(label.selectExpr("node as a", "l as la"), "a").join(label.selectExpr("node as b", "l as lb"), "b").filter("la <> lb")
        both = x.select(F.col("la").alias("l"), "w", "a", "b", F.col("lb").alias("o")).unionAll(x.select(F.col("lb").alias("l"), "w", "a", "b", F.col("la").alias("o")))
        best = cut(both.groupBy("l").agg(F.min(F.struct("w", "a", "b", "o")).alias("m")).select("l", "m.*"))
        if best.isEmpty():
            break
        picked = best.select("a", "b", "w").distinct()
        tree = picked if tree is None else tree.unionAll(picked)
        comp = components(best.select(F.col("l").alias("u"), F.col("o").alias("v")))
        label = cut(label.join(comp.withColumnRenamed("node", "l"), "l", "left").select("node", F.coalesce("component", "l").alias("l")))
    return (tree if tree is not None else e.limit(0).select("a", "b", "w")).withColumnRenamed("w", weight)


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """node, rank; the mass of nodes without edges is shared by all. Stops when the ranks move less than ``tolerance`` in all."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    out = edges.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    e = cut(edges.select("node", "nb").join(out, "node"))
    rank = cut(nodes.select("node", F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        sent = e.join(rank, "node").groupBy(F.col("nb").alias("node")).agg(F.sum(F.col("rank") / F.col("k")).alias("s"))
        loose = rank.join(out, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        base = (1 - damping) / n + damping * loose / n
        both = cut(rank.join(sent, "node", "left").select("node", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")))
        rank = both.select("node", "rank")
        if tolerance > 0 and both.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            break
    return rank


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation: the most frequent label around a node, ties to the smallest."""
    both = cut(edges.select("node", "nb").unionAll(edges.select(F.col("nb").alias("node"), F.col("node").alias("nb"))).distinct())
    label = cut(nodes.select("node", F.col("node").alias("l")))
    for _ in range(rounds):
        seen = both.join(label.selectExpr("node as nb", "l"), "nb").groupBy("node", "l").agg(F.count(F.lit(1)).alias("k"))
        top = seen.groupBy("node").agg(F.max(F.struct("k", (-F.col("l")).alias("m"))).alias("t"))
        new = cut(label.join(top, "node", "left").select("node", F.coalesce(F.least(-F.col("t.m"), "l"), "l").alias("l"), F.col("l").alias("old")))
        label = new.select("node", "l")
        if new.filter("l <> old").isEmpty():
            break
    return label.withColumnRenamed("l", "community")


def box_counts(marked: DataFrame, spec: GridSpec, sizes: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """size, boxes: boxes of each size that hold a marked node."""
    rc = spec.with_rowcol(marked.select("node")).select("r", "c", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    cells = rc.select("size", F.floor(F.col("r") / F.col("size")).alias("i"), F.floor(F.col("c") / F.col("size")).alias("j")).distinct()
    return cells.groupBy("size").agg(F.count(F.lit(1)).alias("boxes"))


def box_dimension(marked: DataFrame, spec: GridSpec, sizes: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    return box_counts(marked, spec, sizes).agg((-F.regr_slope(F.log("boxes"), F.log("size"))).alias("dimension"))


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, value: Brandes' betweenness over unweighted directed edges, sources dealt to tasks in blocks.

    Each task holds the whole graph, so it is for graphs of up to a million edges; larger ones are refused.
    """
    import pandas as pd

    limit = 1_000_000
    if edges.count() > limit:
        raise ValueError(f"betweenness is for at most {limit} edges")
    graph: dict[int, list[int]] = {}
    for r in edges.select("node", "nb").collect():
        graph.setdefault(r[0], []).append(r[1])
    shared = edges.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        graph = shared.value
        total: dict[int, float] = {}
        for pdf in batches:
            for s in pdf["node"]:
                order, paths, dist, parents = [], {s: 1}, {s: 0}, {s: []}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in graph.get(v, ()):
                        if w not in dist:
                            dist[w], paths[w], parents[w] = dist[v] + 1, 0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            parents[w].append(v)
                credit = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in parents[w]:
                        credit[v] += paths[v] / paths[w] * (1 + credit[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + credit[w]
        yield pd.DataFrame({"node": list(total), "value": list(total.values())}, columns=["node", "value"])

    part = nodes.select("node").mapInPandas(run, "node long, value double").groupBy("node").agg(F.sum("value").alias("value"))
    return nodes.select("node").join(part, "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))
