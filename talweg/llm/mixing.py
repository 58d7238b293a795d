"""Mixing sources to target weights by weighted fair queueing; DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_bits, materialise

#: Steps of the grid of finish times per unit of target.
GRID = 1024


@dataclass(frozen=True)
class MixConfig:
    """Sources in order of code point, null last, take the weights in turn; a source is read ``repeats`` times at most."""

    weights: tuple[int, ...] = (5, 2, 1)
    repeats: int = 3
    seed: int = 7


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """Targets by source from (source, size) rows: source, source_size, target.

    All targets sum to all sizes. A target stops at ``repeats`` times its source's size and the excess is
    shared by weight among the others until none is above: the water level, found from running sums over
    sources in order of size by weight. A source without words has target 0.
    """
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in cfg.weights]), (F.pmod(F.col("_i"), F.lit(len(cfg.weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.selectExpr("*", "row_number() over (order by source asc nulls last) - 1 as _i").withColumn("_w", weights)
    s = s.withColumn("_cap", F.lit(float(cfg.repeats)) * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_w"))
    s = s.selectExpr(
        "*",
        "sum(cast(source_size as double)) over () as _all",
        "sum(_w) over () as _ws",
        "coalesce(sum(_cap) over (order by _r, _i rows between unbounded preceding and 1 preceding), 0d) as _capped",
        "coalesce(sum(_w) over (order by _r, _i rows between unbounded preceding and 1 preceding), 0d) as _used",
    )
    s = s.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_ws") - F.col("_used")))
    s = s.selectExpr("*", "min(case when _level < _r then struct(_r, _i, _level) end) over () as _cut")
    return s.select(
        "source",
        "source_size",
        F.when(F.col("_cut").isNull() | (F.col("_r") < F.col("_cut._r")), F.col("_cap"))
        .otherwise(F.col("_w") * F.col("_cut._level"))
        .alias("target"),
    )


def _grid(finish: Column) -> Column:
    """A step of the grid, not falling with the finish time; coarser beyond 2."""
    return F.floor(F.when(finish <= 2, finish * GRID).otherwise(GRID * (2 + F.log(finish / 2)))).cast("long")


def _lane(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _place(doc_id: Column, size: Column, cfg: MixConfig) -> Column:
    """A document's place in its source's queue, before ties by id: 60 bits of a seeded hash."""
    digest = F.md5(F.concat_ws(":", F.lit(cfg.seed).cast("string"), doc_id.cast("string"), size.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document (and the columns ``carry``).

    Documents of a source queue in order of a seeded hash, the whole queue up to ``repeats`` times. A copy's
    virtual finish time is the source's words so far divided by its target; copies are taken in that order
    while the words taken stay within all words. Ties go by source and hash; null sources are a source.
    Documents without words have taken 0, and copies as their place in the queue says. Running sums go by
    hash prefix, so that a hot source is spread over many tasks.
    """
    carry = carry or []
    rows = docs.select(
        *[F.col(c).alias(f"_c_{i}") for i, c in enumerate(carry)],
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    )
    sized = materialise(rows.withColumn("_h", _place(F.col("doc_id"), F.col("size"), cfg)))
    bits = bucket_bits(sized.count())
    sized = sized.withColumn("_hb", F.shiftright("_h", 60 - bits)).withColumn("_s", _lane(F.col("source")))
    parts = materialise(sized.groupBy("source", "_s", "_hb").agg(F.sum("size").alias("size")))
    targets = source_targets(parts, cfg).withColumn("_s", _lane(F.col("source")))
    first = parts.selectExpr("_s", "_hb", "sum(size) over (partition by _s order by _hb) - size as _before")
    first = first.join(targets.drop("source"), "_s")
    queued = sized.selectExpr("*", "sum(size) over (partition by _s, _hb order by _h, doc_id rows unbounded preceding) as _run")
    queued = queued.join(first, ["_s", "_hb"]).withColumn("_at", F.col("_before") + F.col("_run"))
    queued = materialise(queued.drop("_hb", "_before", "_run"))

    turns = F.array(*[F.lit(k) for k in range(cfg.repeats)])
    finish = F.when(F.col("target") > 0, (F.col("_turn") * F.col("source_size") + F.col("_at")) / F.col("target")).otherwise(F.lit(0.0))
    copies = queued.select("_s", "_h", "doc_id", "size", "source_size", "target", "_at", F.explode(turns).alias("_turn")).withColumn("_f", finish)
    copies = copies.select("_s", "_h", "_turn", "doc_id", "size", "_f", _grid(F.col("_f")).alias("_g"))
    steps = copies.groupBy("_g").agg(F.sum("size").alias("_n"))
    budget = parts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_budget"))
    steps = steps.selectExpr("_g", "sum(_n) over (order by _g) - _n as _start", "_n").join(F.broadcast(budget))
    # The step in which the budget runs out; its copies alone are put in order.
    edge = materialise(steps.filter("_start + _n > _budget").orderBy("_g").limit(1))
    last = copies.join(F.broadcast(edge), "_g").selectExpr(
        "*", "_start + sum(size) over (partition by _g order by _f, _s, _h, doc_id, _turn rows unbounded preceding) as _total"
    )
    cut = last.filter("_total > _budget").agg(F.min(F.struct("_f", "_s", "_h", "doc_id", "_turn")).alias("_cut"))
    out = queued.join(F.broadcast(cut))
    taken = F.lit(0)
    for k in range(cfg.repeats):
        at = F.when(F.col("target") > 0, (F.lit(k) * F.col("source_size") + F.col("_at")) / F.col("target")).otherwise(F.lit(0.0))
        here = F.struct(at.alias("_f"), F.col("_s"), F.col("_h"), F.col("doc_id"), F.lit(k).alias("_turn"))
        taken = taken + F.when(F.col("_cut").isNull() | (here < F.col("_cut")), 1).otherwise(0)
    out = out.withColumn("copies", taken)
    return out.select(
        *[F.col(f"_c_{i}").alias(c) for i, c in enumerate(carry)],
        "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    The mix takes of a source's queue all up to some document in each turn, so a row's copies follow from its place and
    the last place of each turn, and texts stay where they are. Rows of such a last place that repeat id, source and
    size have the copies that the mix takes of them dealt out evenly, so the output has the words of the mix. Null ids,
    sources and texts are values as any other; documents without words come as often as their place in the queue says.
    An empty table gives an empty one.
    """
    place = ["_s", "_h", "_id"]
    plan = mix(docs, cfg).select(_lane(F.col("source")).alias("_s"), _place(F.col("doc_id"), F.col("size"), cfg).alias("_h"), F.col("doc_id").alias("_id"), "copies")
    plan = materialise(plan)
    at, turns = F.struct("_h", "_id"), range(cfg.repeats)
    last = materialise(plan.groupBy("_s").agg(*[F.max(F.when(F.col("copies") > k, at)).alias(f"_last_{k}") for k in turns]))
    ends = last.select("_s", F.explode(F.array(*[f"_last_{k}" for k in turns])).alias("_at")).filter("_at is not null").distinct()
    ends = ends.select("_s", "_at._h", F.coalesce(F.col("_at._id").cast("string"), F.lit("-")).alias("_id"))
    by_id = F.coalesce(F.col("_id").cast("string"), F.lit("-"))
    shared = plan.withColumn("_id", by_id).join(ends, place).groupBy(*place).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_n"), F.max("copies").alias("_most"))
    shared = materialise(shared.filter("_copies < _n * _most").drop("_most"))

    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    named = named.select("_row", _lane(F.col("_row.source").cast("string")).alias("_s"), F.col("_row.doc_id").cast("long").alias("_id"), word_count(F.col("_row.text")).alias("_size"))
    named = named.withColumn("_h", _place(F.col("_id"), F.col("_size"), cfg)).join(last, "_s")
    copies = sum((F.when(at <= F.col(f"_last_{k}"), 1).otherwise(0) for k in turns), F.lit(0))
    named = named.select("_row", "_s", "_h", by_id.alias("_id"), copies.cast("long").alias("_copies"))
    whole = named
    if not shared.isEmpty():
        whole = named.join(shared.drop("_copies", "_n"), place, "left_anti")
        k = F.row_number().over(Window.partitionBy(*place).orderBy(F.xxhash64("_row")))
        dealt = named.drop("_copies").join(shared, place).withColumn("_copies", F.floor((F.col("_copies") + F.col("_n") - k) / F.col("_n")))
        whole = whole.select("_row", "_copies").unionAll(dealt.select("_row", "_copies"))
    out = whole.filter("_copies > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
