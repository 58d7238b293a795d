"""Hard-negative mining by a full sort of every anchor's scores, block by block."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

__all__ = ["NegativeConfig", "hard_negatives", "quantised"]


@dataclass(frozen=True)
class NegativeConfig:
    """An anchor's ``positives`` best rows of its label are each given ``negatives`` rows of other labels, the best whose
    score lies between ``low`` and ``high`` percent of the positive's. Scores are taken for ``anchors`` times ``rows``
    vectors in a task, ``sorted`` anchors at a time; these three bound memory and change no result."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    anchors: int = 8192
    rows: int = 8192
    sorted: int = 32


def quantised(vectors: DataFrame, vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a long (saturated); null where the vector or any component is null or
    not finite."""
    v = F.col(f"`{vector}`")
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(whole, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows, filled with zeros up to ``width``."""
    lists = lists.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _width(lists: pa.ChunkedArray) -> int:
    return max((len(x) for x in lists), default=0)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where every partial sum is an exact integer there, else by Python's integers
    (saturated to a long)."""
    most = float(np.abs(anchors.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(1, anchors.shape[1])
    if most < 2**53:
        return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64)
    exact = anchors.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _blocks(anchors: pa.Table, rows: pa.Table, cfg: NegativeConfig, take: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """Call ``take(anchor, order, score)`` for each anchor: rows of the block in order of score (descending) and id
    (nulls last), and their scores in that order."""
    width = max(_width(anchors["av"]), _width(rows["v"]))
    left, right = _matrix(anchors["av"], width), _matrix(rows["v"], width)
    ids, none = rows["vec_id"].fill_null(0).to_numpy(), rows["vec_id"].is_null().to_numpy()
    # rows come in order of their ids once, so a stable sort by score breaks ties by id
    by_id = np.lexsort((rows["u"].to_numpy(), ids, none))
    right = right[by_id]
    for at in range(0, len(left), cfg.sorted):
        scores = _scores(left[at : at + cfg.sorted], right)
        order = np.argsort(-scores, axis=1, kind="stable") if scores.min(initial=0) > -(2**63) else np.argsort(-scores.astype(object), axis=1, kind="stable")
        for k in range(len(scores)):
            take(at + k, by_id[order[k]], scores[k][order[k]])


def _first_positives(cfg: NegativeConfig) -> Callable[..., pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        au, al = anchors["a"].to_numpy(), anchors["al"].to_numpy()
        ru, rl = rows["u"].to_numpy(), rows["label"].to_numpy()

        def take(k: int, order: np.ndarray, score: np.ndarray) -> None:
            same = np.flatnonzero((rl[order] == al[k]) & (ru[order] != au[k]))[: cfg.positives]
            found.append((np.full(len(same), au[k]), order[same], score[same]))

        if len(anchors) and len(rows):
            _blocks(anchors, rows, cfg, take)
        a, r, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        taken = rows.take(pa.array(r.astype(np.int64)))
        return pa.table({"a": pa.array(a, pa.int64()), "pu": taken["u"], "positive_id": taken["vec_id"], "positive_score": pa.array(s, pa.int64())})

    return run


def _first_negatives(cfg: NegativeConfig) -> Callable[..., pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        al, rl = anchors["al"].to_numpy(), rows["label"].to_numpy()
        wanted = anchors["pos"].to_pylist()

        def take(k: int, order: np.ndarray, score: np.ndarray) -> None:
            other = np.flatnonzero(rl[order] != al[k])
            order, score = order[other], score[other]
            falling = -score if len(score) and score[-1] > -(2**63) else -score.astype(object)
            for p in wanted[k]:
                # low * positive <= 100 * negative <= high * positive, in whole numbers of any size
                most, least = cfg.high * p["positive_score"] // 100, -(-cfg.low * p["positive_score"] // 100)
                start = int(np.searchsorted(falling, -most))
                end = min(start + cfg.negatives, int(np.searchsorted(falling, -least, side="right")))
                if end > start:
                    n = end - start
                    found.append((np.full(n, k), np.full(n, p["pu"]), order[start:end], score[start:end]))

        if len(anchors) and len(rows):
            _blocks(anchors, rows, cfg, take)
        k, pu, r, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
        taken = rows.take(pa.array(r.astype(np.int64)))
        a = anchors["a"].take(pa.array(k.astype(np.int64)))
        return pa.table({"a": a, "pu": pa.array(pu, pa.int64()), "nu": taken["u"], "negative_id": taken["vec_id"], "negative_score": pa.array(s, pa.int64())})

    return run


def _pairs(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, cfg: NegativeConfig, run: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``run`` over every block of anchors with every block of rows."""
    parts, blocks = max(1, -(-n_anchors // cfg.anchors)), max(1, -(-n_rows // cfg.rows))
    left = anchors.withColumn("ab", F.pmod(F.xxhash64("a"), F.lit(parts))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("u"), F.lit(blocks))).withColumn("ab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, cfg: NegativeConfig = NegativeConfig(), every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and v (whole numbers); further columns are ignored. Anchors are rows whose vec_id is
    divisible by ``every``. Scores are exact inner products; higher ones come first, ties by smaller vec_id (null last).
    Each task sorts all scores of its block of rows for each of its anchors; what can be among the first few of all rows
    is among the first few of a block, so blocks are merged by rank and nothing of the size of the table meets in a task.

    Rows with a null label or vector take no part; nor do they as anchors with a null vec_id. Rows that repeat id, label
    and vector count once; rows that share an id only are rows of their own. A shorter vector counts as if filled with
    zeros, an empty one scores 0. Scores beyond a long saturate. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v").filter("label is not null and v is not null")
    rows = materialise(rows.distinct().withColumn("u", F.monotonically_increasing_id()))
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("u").alias("a"), "vec_id", F.col("label").alias("al"), F.col("v").alias("av"))
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    schema = "a long, pu long, positive_id long, positive_score long"
    best = _pairs(anchors.drop("vec_id"), rows, n_anchors, n_rows, cfg, _first_positives(cfg), schema)
    order = Window.partitionBy("a").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "pu")
    best = materialise(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.positives).drop("rank"))
    told = best.groupBy("a").agg(F.collect_list(F.struct("pu", "positive_score")).alias("pos"))  # at most ``positives`` each
    schema = "a long, pu long, nu long, negative_id long, negative_score long"
    found = _pairs(anchors.drop("vec_id").join(told, "a"), rows, n_anchors, n_rows, cfg, _first_negatives(cfg), schema)
    order = Window.partitionBy("a", "pu").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "nu")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.negatives)
    ids = anchors.select("a", F.col("vec_id").alias("anchor_id"))
    return found.join(best, ["a", "pu"]).join(ids, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
