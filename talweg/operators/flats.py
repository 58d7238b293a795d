"""Fills that drain: flats of a filled surface get a slope towards where they spill and away from higher ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boundary as B
from ..functions.grid import D8, GridSpec
from ..scratch import cut
from .components import components
from .depressions import fill
from .neighbours import neighbours
from .parts import least, tile_of


def _leaving(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """node of the nodes that may let flow out: by boundary code, else the grid's edge."""
    if "bc" in nodes.columns:
        return nodes.filter(B.can_out(F.col("bc"))).select("node")
    rc = spec.with_rowcol(nodes)
    return rc.filter(spec.on_edge(F.col("r"), F.col("c"))).select("node")


def flat_steps(surface: DataFrame, leaving: DataFrame, spec: GridSpec, around: list[tuple[int, int, int]] = D8, rounds: int | None = None) -> DataFrame:
    """node, toward, away, steps of each still node (node, z): one that has no lower neighbour and isn't leaving.

    ``toward``: steps over still nodes of its height to one next to a node of this height that drains, 1 there; null if
    there is none (or none within ``rounds``). ``away``: likewise to one next to a higher node; null if there is none.
    ``steps`` = 2 * toward + (greatest away of the flat - away): a node nearer to the way out has fewer, whatever away is,
    since away differs by one at most between neighbours. Two searches from all borders at once, each over edges within
    flats only; flats are components of these edges.
    """
    e = cut(neighbours(surface.select("node", "z"), spec, around).select("node", "nb", "z", "z_nb"))
    kind = e.groupBy("node").agg(F.max((F.col("z_nb") < F.col("z")).cast("int")).alias("drains"), F.max((F.col("z_nb") > F.col("z")).cast("int")).alias("below"))
    kind = kind.join(leaving.select("node").distinct().withColumn("out", F.lit(1)), "node", "left")
    kind = cut(kind.select("node", (F.coalesce("drains", F.lit(0)) + F.coalesce("out", F.lit(0)) == 0).alias("still"), (F.col("below") == 1).alias("under")))
    level = e.filter("z = z_nb").select("node", "nb").join(kind.filter("still").select("node"), "node")
    level = cut(level.join(kind.select(F.col("node").alias("nb"), F.col("still").alias("still_nb")), "nb"))
    inside = cut(level.filter("still_nb").select("node", "nb"))
    one = F.lit(1.0).alias("value")

    def steps_from(starts: DataFrame) -> DataFrame:
        found = least(inside, starts.select("node", one), lambda n: tile_of(n, spec)).select("node", F.col("value").cast("long").alias("value"))
        return found if rounds is None else found.filter(F.col("value") <= rounds + 1)

    toward = steps_from(level.filter("not still_nb").select("node").distinct())
    away = steps_from(kind.filter("still and under"))
    flat = components(inside.selectExpr("node as u", "nb as v"))
    out = kind.filter("still").select("node").join(toward.withColumnRenamed("value", "toward"), "node", "left").join(away.withColumnRenamed("value", "away"), "node", "left")
    out = cut(out.join(flat, "node", "left").withColumn("flat", F.coalesce("component", "node")).drop("component"))
    top = out.groupBy("flat").agg(F.max("away").alias("top"))
    steps = 2 * F.col("toward") + F.coalesce(F.col("top") - F.col("away"), F.lit(0))
    return out.join(top, "flat").select("node", "flat", "toward", "away", steps.alias("steps"))


def fill_draining(nodes: DataFrame, spec: GridSpec, epsilon: float = 1e-6, max_depth: float | None = None, rounds: int | None = None, preserve_flat: bool = False, around: list[tuple[int, int, int]] = D8) -> DataFrame:
    """node, z, filled, steps: the surface without depressions, and without flats: each node that can reach an outlet has a
    lower neighbour or is one.

    A flat's nodes are raised by ``epsilon`` times their steps (``flat_steps``), which should be less than the least
    difference of heights over the steps of a flat; ``preserve_flat`` leaves flats flat. A node that would be filled by
    more than ``max_depth`` keeps its height, and so may hold water. ``rounds`` limits the searches, after which flats
    farther from their ways out than that stay flat. Filling a filled surface changes nothing.
    """
    flooded = fill(nodes, spec, around)
    if max_depth is not None:
        flooded = flooded.select("node", "z", F.when(F.col("filled") - F.col("z") > max_depth, F.col("z")).otherwise(F.col("filled")).alias("filled"))
    flooded = cut(flooded)
    if preserve_flat:
        return flooded.withColumn("steps", F.lit(0).cast("long"))
    steps = flat_steps(flooded.select("node", F.col("filled").alias("z")), _leaving(nodes, spec), spec, around, rounds)
    out = flooded.join(steps.select("node", F.coalesce("steps", F.lit(0)).alias("steps")), "node", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    return out.select("node", "z", (F.col("filled") + F.lit(epsilon) * F.col("steps")).alias("filled"), "steps")
