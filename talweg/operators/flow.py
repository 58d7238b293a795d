"""Flow directions: steepest receivers, downhill edges, gradients and partition weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import D8, GridSpec
from ..functions.vectors import noise
from .neighbours import neighbours



def downhill(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8, keep: list[str] | None = None) -> DataFrame:
    """Edges to lower neighbours: node, nb, dir, dr, dc, dx, z, z_nb, slope. With boundary codes (column bc) the
    giver must be able to give and the receiver to receive; a node that forces its neighbours takes only them."""
    coded = "bc" in nodes.columns
    values = ["z", *(["bc"] if coded else []), *(keep or [])]
    e = neighbours(nodes, spec, around, values)
    ok = F.col("z") > F.col("z_nb")
    if coded:
        forced = (B.forces_receiving(F.col("bc_nb")) | B.forces_giving(F.col("bc"))) & (F.col("z") != F.col("z_nb"))
        ok = (ok | forced) & B.can_give(F.col("bc")) & B.can_receive(F.col("bc_nb"))
    return e.filter(ok).withColumn("slope", (F.col("z") - F.col("z_nb")) / F.col("dx"))


def steepest(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8, stochastic: float | None = None, seed: int = 0, edges: DataFrame | None = None) -> DataFrame:
    """node, rec, dx, slope: the receiver of steepest descent, itself where there is none.

    Ties go to the smallest receiver id. ``stochastic`` scales each slope by a seeded random number times it,
    plus 1e-6. With boundary codes a link to a node that forces receiving wins over any other.
    """
    e = edges if edges is not None else downhill(nodes, spec, around)
    key = F.col("slope")
    if stochastic is not None:
        key = key * noise(seed, F.struct("node", "nb")) * stochastic + 1e-6
    forced = B.forces_receiving(F.col("bc_nb")).cast("int") if "bc_nb" in e.columns else F.lit(0)
    best = e.groupBy("node").agg(F.max(F.struct(forced.alias("f"), key.alias("k"), (-F.col("nb")).alias("b"), "dx", "slope")).alias("m"))
    best = best.select("node", (-F.col("m.b")).alias("rec"), "m.dx", "m.slope")
    return _all_nodes(nodes, best)


def _all_nodes(nodes: DataFrame, best: DataFrame) -> DataFrame:
    active = nodes.filter(B.is_active(F.col("bc"))) if "bc" in nodes.columns else nodes
    return active.select("node").join(best, "node", "left").select(
        "node", F.coalesce("rec", "node").alias("rec"), F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("slope", F.lit(0.0)).alias("slope")
    )


def lowest(nodes: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8) -> DataFrame:
    """node, rec, dx, slope: the lowest lower neighbour, whatever its distance."""
    best = downhill(nodes, spec, around).groupBy("node").agg(F.min(F.struct("z_nb", "nb", "dx", "slope")).alias("m"))
    return _all_nodes(nodes, best.select("node", F.col("m.nb").alias("rec"), "m.dx", "m.slope"))


def drawn(nodes: DataFrame, spec: GridSpec, weighted: bool = False, seed: int = 0, min_gradient: float = 0.0) -> DataFrame:
    """node, rec, dx, slope: a receiver drawn at random among those steeper than ``min_gradient``, evenly or by slope."""
    e = downhill(nodes, spec).filter(F.col("slope") > min_gradient)
    u = F.greatest(noise(seed, F.struct("node", "nb")), F.lit(1e-12))
    key = -F.log(u) / F.col("slope") if weighted else u  # exponential race: the least has probability by weight
    best = e.groupBy("node").agg(F.min(F.struct(key.alias("k"), "nb", "dx", "slope")).alias("m"))
    return _all_nodes(nodes, best.select("node", F.col("m.nb").alias("rec"), "m.dx", "m.slope"))


def by_discharge(nodes: DataFrame, spec: GridSpec, q: str, exponent: float | None = None, seed: int = 0) -> DataFrame:
    """node, rec, dx, slope: the receiver of most discharge; with ``exponent``, drawn by discharge^exponent / slope."""
    e = downhill(nodes, spec, keep=[q])
    key = -F.col(f"{q}_nb")
    if exponent is not None:
        u = F.greatest(noise(seed, F.struct("node", "nb")), F.lit(1e-12))
        key = -F.log(u) / (F.pow(F.greatest(F.col(f"{q}_nb"), F.lit(1e-12)), F.lit(exponent)) / F.col("slope"))
    best = e.groupBy("node").agg(F.min(F.struct(key.alias("k"), "nb", "dx", "slope")).alias("m"))
    return _all_nodes(nodes, best.select("node", F.col("m.nb").alias("rec"), "m.dx", "m.slope"))


def link_gradient(edges: DataFrame, least: float = 1e-6) -> DataFrame:
    return edges.withColumn("gradient", F.greatest(F.col("slope"), F.lit(least)))


def shares(edges: DataFrame, weight: Column, out: str = "weight") -> DataFrame:
    """Weights that sum to 1 over the edges of each node: a sum by node, joined back on the node. Without
    positive weights the edges share evenly."""
    e = edges.withColumn("_w", weight)
    total = e.groupBy("node").agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return e.join(total, "node").withColumn(out, F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(1 / F.col("_n"))).drop("_w", "_t", "_n")


def exponent_weights(edges: DataFrame, exponent: float) -> DataFrame:
    """Exponent 0 or less: equal shares; 1: by slope; else by slope to the exponent."""
    if exponent <= 0:
        return shares(edges, F.lit(1.0))
    return shares(edges, F.col("slope") if exponent == 1 else F.pow("slope", F.lit(exponent)))


def partition(edges: DataFrame, method: str, exponent: float = 1.0) -> DataFrame:
    """Multiple flow by method: freeman (S), quinn and holmgren (S^p), seibert (S^(1+n/2)), tarboton (0.8 to the
    steepest, 0.2 to the others evenly; all of it where there is one receiver)."""
    if method == "freeman":
        return shares(edges, F.col("slope"))
    if method in ("quinn", "holmgren"):
        return shares(edges, F.pow("slope", F.lit(exponent)))
    count = edges.groupBy("node").agg(F.count(F.lit(1)).alias("_k"), F.max(F.struct("slope", -F.col("nb"))).alias("_s"))
    e = edges.join(count, "node")
    if method == "seibert":
        return shares(e, F.pow(F.col("slope"), 1 + F.col("_k") / 2)).drop("_k", "_s")
    if method == "tarboton":
        first = F.col("nb") == -F.col("_s.col2")
        w = F.when(F.col("_k") == 1, 1.0).when(first, 0.8).otherwise(0.2 / (F.col("_k") - 1))
        return e.withColumn("weight", w).drop("_k", "_s")
    raise ValueError(f"unknown method {method}")


def hydraulic_weights(edges: DataFrame, spec: GridSpec, mode: str = "slope", diagonals: bool = True, stochastic: float = 0.0, seed: int = 0) -> DataFrame:
    """Shares by slope x width ("slope"), square root of slope x width ("sqrt"), or evenly ("receivers")."""
    e = edges if diagonals else edges.filter("dr = 0 or dc = 0")
    width = F.when((F.col("dr") != 0) & (F.col("dc") != 0), F.lit(spec.dxy)).when(F.col("dr") != 0, F.lit(spec.dx)).otherwise(F.lit(spec.dy))
    w = {"slope": F.col("slope") * width, "sqrt": F.sqrt("slope") * width, "receivers": F.lit(1.0)}[mode]
    if stochastic:
        w = w * (1 + stochastic * noise(seed, F.struct("node", "nb")))
    return shares(e.withColumn("width", width), w)


def sfd_gradient(nodes: DataFrame, sfd: DataFrame) -> DataFrame:
    """node, gradient: (z - z of the receiver) / dx; 0 where a node is its own receiver."""
    z = nodes.select("node", "z")
    e = sfd.filter("node <> rec").join(z, "node").join(z.select(F.col("node").alias("rec"), F.col("z").alias("z_rec")), "rec")
    got = e.select("node", ((F.col("z") - F.col("z_rec")) / F.col("dx")).alias("gradient"))
    return sfd.select("node").join(got, "node", "left").select("node", F.coalesce("gradient", F.lit(0.0)).alias("gradient"))


def mean_gradient(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """node, gradient: mean slope to the receivers, weighted if a weight column is named."""
    if weight is None:
        return edges.groupBy("node").agg(F.avg("slope").alias("gradient"))
    return edges.groupBy("node").agg((F.sum(F.col("slope") * F.col(weight)) / F.sum(weight)).alias("gradient"))


def receiver_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _counts(nodes, edges, "node")


def donor_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _counts(nodes, edges, "nb")


def _counts(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    n = edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("node").join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sfd_donors(sfd: DataFrame) -> DataFrame:
    """node, n, donors (sorted): who gives to each node by single flow."""
    d = sfd.filter("node <> rec").groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("node")).alias("donors"))
    out = sfd.select("node").join(d.withColumnRenamed("rec", "node"), "node", "left")
    return out.select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("donors", F.array().cast("array<bigint>")).alias("donors"))


def potential_receivers(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node, n: neighbours that could take flow whatever their elevation."""
    e = neighbours(nodes, spec, values=["bc"]).filter(B.can_give(F.col("bc")) & B.can_receive(F.col("bc_nb")))
    return _counts(nodes, e, "node")


def max_link_value(edges: DataFrame, value: str) -> DataFrame:
    """node, value: the largest value among the links at a node, whichever end it is."""
    both = edges.select("node", value).unionAll(edges.select(F.col("nb").alias("node"), value))
    return both.groupBy("node").agg(F.max(value).alias(value))


def outlets(sfd: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are their own receiver and may let flow out of the model."""
    out = sfd.filter("node = rec").select("node").join(nodes, "node")
    return out.filter(B.can_out(F.col("bc"))).select("node")


def pits(sfd: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are their own receiver and may not let flow out."""
    out = sfd.filter("node = rec").select("node").join(nodes, "node")
    return out.filter(~B.can_out(F.col("bc"))).select("node")
