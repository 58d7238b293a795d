"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import release
from .text import chunks

U32 = np.uint32


@dataclass(frozen=True)
class ToxicityConfig:
    """``positives`` and ``negatives`` bound the labelled rows that the model is trained on.

    A text is scored by passages of ``passage`` words (all of them, the last one shorter): the distinct subwords
    of a passage are averaged, and the highest passage is the text's score, so that long texts don't thin it
    out. A passage of fewer than ``least`` distinct subwords counts as padded with subwords of weight 0: one
    word written over and over is little evidence. In training the share ``drop`` of subwords is left out at random.
    """

    positives: int = 1500
    negatives: int = 2500
    bits: int = 17
    width: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    passage: int = 8
    least: int = 40
    warm_epochs: int = 2
    epochs: int = 14
    batch: int = 64
    rate: float = 0.02
    drop: float = 0.3
    seed: int = 11


@dataclass
class ToxicityModel:
    """What scoring needs: the linear score of each subword bucket, and the bias."""

    weight: np.ndarray
    bias: float
    cfg: ToxicityConfig


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row may not be learnt: crc32 of the id as text, modulo 5, is 0 (null id: of '')."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5) == 0


def subwords(texts: list[str], cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct character n-grams of the texts' words (with a border at both ends), the passage of
    each, and the number of passages up to each text. A text without words has one passage without subwords."""
    points = np.frombuffer((" " + "  ".join(t.lower() for t in texts) + " ").encode("utf-32-le", "surrogatepass"), U32)
    lengths = np.array([len(t.lower()) for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths + 2)])[:-1]
    space = (points == 32) | ((points >= 9) & (points <= 13))
    first = np.flatnonzero(~space[1:] & space[:-1]) + 1
    of = np.searchsorted(begins, first, "right") - 1
    words = np.bincount(of, minlength=len(texts))
    before = np.cumsum(words) - words
    passages = np.maximum(1, -(-words // cfg.passage))
    ends = np.cumsum(passages)
    passage_of_word = (ends - passages)[of] + (np.arange(len(first)) - before[of]) // cfg.passage
    word_at = np.cumsum(np.bincount(first - 1, minlength=len(points))) - 1  # a word begins with the space before it
    buckets, owner = [], []
    mixed = points * U32(0x9E3779B1)
    mixed[space] = U32(0x85EBCA6B)
    h = np.zeros(len(points), U32)
    gaps = np.zeros(len(points) + 1, np.int32)
    np.cumsum(space, out=gaps[1:])
    for n in range(1, max(cfg.grams) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        h = (h[:size] * U32(0x01000193)) ^ mixed[n - 1 :][:size]
        if n in cfg.grams:
            inner = gaps[n - 1 : n - 1 + size] - gaps[1 : size + 1]  # spaces strictly inside
            ok = np.flatnonzero((inner == 0) & ~(space[:size] & space[n - 1 : n - 1 + size]))
            x = h[ok]
            x = (x ^ (x >> U32(15))) * U32(0x2C1B3C6D)
            x = (x ^ (x >> U32(12))) * U32(0x297A2D39)
            buckets.append((x ^ (x >> U32(15))) >> U32(32 - cfg.bits))
            owner.append(passage_of_word[word_at[ok]] if len(first) else np.empty(0, np.int64))
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64), ends
    cell = np.sort(np.concatenate(owner) << cfg.bits | np.concatenate(buckets).astype(np.int64))
    cell = cell[np.concatenate([[True], cell[1:] != cell[:-1]])] if len(cell) else cell
    return cell & ((1 << cfg.bits) - 1), cell >> cfg.bits, ends


def _passage_means(weight: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int, least: int) -> np.ndarray:
    count = np.bincount(owner, minlength=n)
    return np.bincount(owner, weights=weight[bucket], minlength=n) / np.maximum(count, least)


def text_scores(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    """The probability of each text; a text without words gets that of the bias alone."""
    bucket, owner, ends = subwords(texts, model.cfg)
    means = _passage_means(model.weight, bucket, owner, int(ends[-1]), model.cfg.least)
    top = np.maximum.reduceat(means, np.concatenate([[0], ends[:-1]]))
    return 1 / (1 + np.exp(-np.clip(top + model.bias, -60, 60)))


def train(texts: list[str], labels: np.ndarray, prior: float, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Embeddings and softmax weights by Adam. The first epochs average whole texts, later ones the text's
    highest passage. ``prior`` is the share of label 1 among all labelled rows; the sample's is corrected."""
    labels = np.asarray(labels, float)
    if not len(texts) or labels.min() == labels.max():
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return ToxicityModel(np.zeros(1 << cfg.bits), float(np.log(p / (1 - p))), cfg)
    rng = np.random.default_rng(cfg.seed)
    E = rng.normal(0, 0.1, (1 << cfg.bits, cfg.width))
    w, bias = rng.normal(0, 0.5, cfg.width), 0.0
    m, v = np.zeros_like(E), np.zeros_like(E)
    mw, vw, mb, vb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    share = labels.mean()
    for epoch in range(cfg.warm_epochs + cfg.epochs):
        rate = cfg.rate * (1 - epoch / (cfg.warm_epochs + cfg.epochs))
        order = rng.permutation(len(texts))
        for i in range(0, len(order), cfg.batch):
            rows = order[i : i + cfg.batch]
            bucket, owner, ends = subwords([texts[r] for r in rows], cfg)
            begins = np.concatenate([[0], ends[:-1]])
            of = np.searchsorted(ends, owner, "right")
            if epoch >= cfg.warm_epochs:
                means = _passage_means(E @ w, bucket, owner, int(ends[-1]), cfg.least)
                best = np.array([b + int(np.argmax(means[b:e])) for b, e in zip(begins, ends)])
                keep = owner == best[of]
                bucket, of = bucket[keep], of[keep]
            if cfg.drop:
                keep = rng.random(len(bucket)) >= cfg.drop
                bucket, of = bucket[keep], of[keep]
            if not len(bucket):
                continue
            count = np.maximum(np.bincount(of, minlength=len(rows)), cfg.least)
            # a bucket in several passages of a text is one entry with a weight
            cell, times = np.unique(of * (1 << cfg.bits) + bucket, return_counts=True)
            of, bucket = cell >> cfg.bits, cell & ((1 << cfg.bits) - 1)
            part = times / count[of]
            hidden = np.stack([np.bincount(of, weights=part * E[bucket, d], minlength=len(rows)) for d in range(cfg.width)], 1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w + bias, -60, 60)))
            g = (p - labels[rows]) / len(rows)
            gw, gb = g @ hidden, g.sum()
            used, at = np.unique(bucket, return_inverse=True)
            flow = np.bincount(at, weights=part * g[of], minlength=len(used))
            step += 1
            ge = flow[:, None] * w[None, :]
            m[used] = 0.9 * m[used] + 0.1 * ge
            v[used] = 0.99 * v[used] + 0.01 * ge * ge
            fix = np.sqrt(1 - 0.99 ** min(step, 2000)) / (1 - 0.9**step)
            E[used] -= 10 * rate * fix * m[used] / (np.sqrt(v[used]) + 1e-9)
            mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
            w = w - rate * fix * mw / (np.sqrt(vw) + 1e-9)
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            bias -= rate * fix * mb / (np.sqrt(vb) + 1e-9)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return ToxicityModel(E @ w, float(bias), cfg)


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on at most ``positives`` + ``negatives`` labelled rows outside the held-out fold, drawn by hash.

    Rows without a label, id or text are not learnt from; of an id that is labelled twice one row is used.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [
        known.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(cfg.seed), "doc_id"), "doc_id").limit(n)
        for y, n in ((1, cfg.positives), (0, cfg.negatives))
    ]
    sample = F.broadcast(drawn[0].unionAll(drawn[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").filter("text is not null").collect()
    seen: dict[int, tuple[int, str]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["y"], r["text"])):
        seen.setdefault(r["doc_id"], (r["y"], r["text"]))
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    model = train([t for _, t in seen.values()], np.array([y for y, _ in seen.values()]), prior, cfg)
    del rows, seen
    release()  # on the driver, whose memory the sample and the training took
    return model


def score(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """Add each row's score (0 to 1) by its whole text; null text counts as empty. A column ``out`` is replaced."""
    kept = [c for c in docs.columns if c != out]
    src = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                scores = [text_scores(model, run) for run in chunks(texts, lambda t: len(t) + 32, 1 << 18)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores))], names=[*kept, out])
        release()

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField(out, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have the bias alone, very long ones are read whole, passage by passage. A null id is not in the
    held-out fold's sense defined and gives a null held_out; rows that repeat an id each have their score.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(rows, fit(docs, labels, cfg))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
