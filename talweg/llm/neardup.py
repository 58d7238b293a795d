"""Near duplicates: MinHash bands find candidates, odd sketches (Mitzenmacher, Pagh and Pham, 2014) estimate
their similarity, full shingle sets confirm it, and links make groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import materialise, release, split_by_keys
from .text import U64, mix, shingles, word_hashes


@dataclass(frozen=True)
class NearDupConfig:
    """Words of a shingle, the least similarity (per cent) of a link, and the signature's shape.

    A pair of similarity s meets in a band with probability 1 - (1 - s^rows)^bands: at 0.8 all but 3 in a
    million. ``sketch_bits`` must be a multiple of 64. ``slack`` is how many standard deviations the sketch's
    estimate may fall short of the threshold before a candidate is refused. Up to ``rounds`` rounds confirm
    ``partners`` pairs for each class before the remaining pairs are taken; they change no result. Bands in
    which more of these are plausible than four to a member are compared in blocks of ``block`` members.
    """

    words: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    sketch_bits: int = 512
    slack: float = 5.0
    seed: int = 3
    salt_rows: int = 512
    rounds: int = 4
    partners: int = 3
    block: int = 512

    def refused_above(self) -> int:
        """The largest count of unequal sketch bits that a pair of the least similarity may show.

        k samples differ in about k(1-s) places; each puts two elements into the difference of the sketched
        sets, and an odd sketch of n bits of d elements has n(1 - (1 - 2/n)^d)/2 ones on average.
        """
        k, n, s = self.bands * self.rows, self.sketch_bits, self.percent / 100
        left = (1 - 2 / n) ** (2 * k * (1 - s))
        share = (1 - left) / 2
        deviation = (n * share * (1 - share) + (2 * left) ** 2 * k * s * (1 - s)) ** 0.5
        return int(n * share + self.slack * deviation) + 1


class Sketcher:
    """MinHash samples, their band hashes and their odd sketch."""

    def __init__(self, cfg: NearDupConfig) -> None:
        k = cfg.bands * cfg.rows
        rng = np.random.default_rng(cfg.seed)
        self.cfg = cfg
        self.a = (rng.integers(0, 1 << 63, (k, 1), dtype=np.uint64) << U64(1)) | U64(1)
        self.b = rng.integers(0, 1 << 63, (k, 1), dtype=np.uint64)
        self.place = mix(np.arange(1, k + 1, dtype=np.uint64))

    def samples(self, ids: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(ids), 1024):
            np.minimum(best, (self.a * ids[None, i : i + 1024] + self.b).min(axis=1), out=best)
        return best

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        samples = mix(self.samples(ids) ^ self.place)
        bands = np.zeros(self.cfg.bands, np.uint64)
        for r in range(self.cfg.rows):
            bands = mix(bands * U64(3) + samples[r :: self.cfg.rows])
        bit = (samples % U64(self.cfg.sketch_bits)).astype(np.int64)
        odd = np.bincount(bit, minlength=self.cfg.sketch_bits) & 1
        return bands, np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return shingles(word_hashes((text or "").encode("utf-8"))[0], words)


def signatures(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """id, n_shingles, a 128-bit key of the set, band hashes and sketch of each row of (id, text).

    An empty set has no key, bands or sketch.
    """
    fields = "id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(cfg)
        none = np.empty(0, np.uint64)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                n, k1, k2, bands, sketch = [], [], [], [], []
                for text in part.column(1):
                    ids = shingle_set(text.as_py(), cfg.words)
                    n.append(len(ids))
                    k1.append(int(ids.sum(dtype=np.uint64).astype(np.int64)) if len(ids) else None)
                    k2.append(int(mix(ids + U64(0x1234567)).sum(dtype=np.uint64).astype(np.int64)) if len(ids) else None)
                    x, y = sketcher(ids) if len(ids) else (none, none)
                    bands.append(x)
                    sketch.append(y)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _longs(bands), _longs(sketch)],
                    names=["id", "n_shingles", "k1", "k2", "bands", "sketch"],
                )
        release()

    return docs.mapInArrow(run, fields)


def plausible(n1: Column, s1: Column, n2: Column, s2: Column, cfg: NearDupConfig) -> Column:
    """Whether set sizes and odd sketches (arrays of longs) allow a link."""
    unequal = F.lit(0)
    for i in range(cfg.sketch_bits // 64):
        unequal = unequal + F.bit_count(F.get(s1, F.lit(i)).bitwiseXOR(F.get(s2, F.lit(i))))
    return (100 * F.least(n1, n2) >= cfg.percent * F.greatest(n1, n2)) & (unequal <= cfg.refused_above())


def confirm(pairs: DataFrame, docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """The pairs (x, y) whose full shingle sets are similar enough.

    Texts are grouped by x: a task holds x's set and streams the texts of its partners. An x with many
    partners is dealt to several tasks by salt.
    """
    pairs = materialise(pairs)
    ids = pairs.select("x").unionAll(pairs.select("y")).distinct()
    texts = split_by_keys(docs, "id", ids)[0]
    per_x = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / cfg.salt_rows).cast("int").alias("salts"))
    salts = per_x.select("x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    heads = salts.join(texts, salts.x == texts.id).select("x", "salt", F.lit(None).cast("long").alias("y"), "text")
    dealt = pairs.join(per_x, "x").withColumn("salt", F.pmod(F.xxhash64("y"), F.col("salts")).cast("int"))
    members = dealt.join(texts, dealt.y == texts.id).select("x", "salt", "y", "text")
    rows = heads.unionAll(members).repartition("x", "salt").sortWithinPartitions("x", "salt", F.col("y").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        of = None
        for b in batches:
            xs, ys = [], []
            for x, salt, y, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                ids = shingle_set(text.as_py(), cfg.words)
                if y is None:
                    heads = [*heads, ids] if of == (x, salt) else [ids]
                    of = (x, salt)
                    continue
                for head in heads:
                    both = len(np.intersect1d(head, ids, assume_unique=True))
                    if 100 * both >= cfg.percent * (len(head) + len(ids) - both):
                        xs.append(x)
                        ys.append(y)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return rows.mapInArrow(run, "x long, y long")


def _pair_ok(n1: np.ndarray, s1: np.ndarray, n2: np.ndarray, s2: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    """plausible() for numpy: sizes and sketches that broadcast against each other."""
    sized = 100 * np.minimum(n1, n2) >= cfg.percent * np.maximum(n1, n2)
    return sized & (np.bitwise_count(s1 ^ s2).sum(-1) <= cfg.refused_above())


def _remaining(batches: Iterator[pa.RecordBatch], cfg: NearDupConfig) -> Iterator[pa.RecordBatch]:
    """Rows (h, label, y, n, sketch) come sorted by band and label. The plausible pairs (x, y) of different labels
    of a band; or, where they are more than four to a member, the members (x null) with their labels."""
    names = ["h", "x", "y", "label"]

    def out(h, x, y, label) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (h, x, y, label)], names=names)

    def band(h: int, label: np.ndarray, y: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        xs, ys, found = [], [], 0
        for i in range(len(y) - 1):
            after = int(np.searchsorted(label, label[i], "right"))
            hit = after + np.flatnonzero(_pair_ok(n[i], sketch[i], n[after:], sketch[after:], cfg))
            found += len(hit)
            if found > 4 * len(y):
                return out(np.full(len(y), h), [None] * len(y), y, label)
            xs.append(np.full(len(hit), y[i]))
            ys.append(y[hit])
        if not found:
            return out([], [], [], [])
        x, y2 = np.concatenate(xs), np.concatenate(ys)
        return out(np.full(len(x), h), np.minimum(x, y2), np.maximum(x, y2), [None] * len(x))

    held: list[np.ndarray] | None = None
    words = cfg.sketch_bits // 64
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cols.append(b.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words))
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        edges = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        for s, e in zip(edges[:-1], edges[1:]):
            yield band(int(cols[0][s]), *[c[s:e] for c in cols[1:]])
        held = [c[edges[-1] :] for c in cols]
    if held is not None:
        yield band(int(held[0][0]), *held[1:])


def compare_blocks(members: DataFrame, docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Links (x, y) between the members (h, y, label) of a band whose labels differ, by full sets.

    Members outside the band's most frequent label are dealt into blocks, and all members too; each pair of
    blocks is a task's work, which holds one block's sets and streams the other. Only links leave the task.
    """
    members = materialise(members)
    size = members.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k"))
    top = size.groupBy("h").agg(F.max(F.struct("k", "label")).alias("t"), F.sum("k").alias("m"))
    blocks = top.select("h", F.col("t.label").alias("main"), F.ceil(F.col("m") / cfg.block).cast("int").alias("nx"), F.ceil((F.col("m") - F.col("t.k")) / cfg.block).cast("int").alias("ny"))
    dealt = members.join(blocks, "h")
    x = dealt.select("h", F.pmod(F.xxhash64("y"), "nx").cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"), F.lit(1).alias("role"), "y", "label")
    y = dealt.filter("label <> main").select("h", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.pmod(F.xxhash64(F.lit(1), "y"), "ny").cast("int").alias("by"), F.lit(0).alias("role"), "y", "label")
    texts = split_by_keys(docs, "id", members.select("y").distinct())[0]
    sent = x.unionAll(y).join(texts, F.col("y") == F.col("id")).select("h", "bx", "by", "role", "y", "label", "text")
    sent = sent.repartition("h", "bx", "by").sortWithinPartitions("h", "bx", "by", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, labels, sets, flat, row = None, [], [], [], None, None
        for b in batches:
            xs, ys = [], []
            for h, i, j, role, y, label, text in zip(*(b.column(k).to_pylist() for k in range(6)), b.column(6)):
                if of != (h, i, j):
                    of, ids, labels, sets, flat = (h, i, j), [], [], [], None
                mine = shingle_set(text.as_py(), cfg.words)
                if role == 0:
                    ids.append(y)
                    labels.append(label)
                    sets.append(mine)
                    continue
                if not ids:
                    continue
                if flat is None:  # the block's sets as one sorted list of (shingle, member)
                    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    order = np.argsort(flat, kind="stable")
                    flat, row, size, tag = flat[order], row[order], np.array([len(s) for s in sets]), np.array(labels)
                lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                run_of = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
                both = np.bincount(row[run_of], minlength=len(ids))
                ok = (100 * both >= cfg.percent * (size + len(mine) - both)) & (tag != label)
                for k in np.flatnonzero(ok):
                    xs.append(min(ids[k], y))
                    ys.append(max(ids[k], y))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return sent.mapInArrow(run, "x long, y long").distinct()


def _labelled(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return met.withColumn("label", F.col("y"))
    return met.join(labels, met.y == labels.node, "left").select("h", "y", "n", "sketch", F.coalesce("component", "y").alias("label"))


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents.

    A row's set is its distinct shingles of ``words`` words (A-Z as a-z); with fewer words, the whole sequence
    as one. Rows are linked if their sets' Jaccard similarity is ``percent`` or more; a component's id is its
    smallest doc_id, and that row is kept. Without words or text a set is empty and linked with nothing. A null
    doc_id is linked with nothing, has a null component and is kept. Repeated ids share their component.

    Equal sets become one class first. In each of a few rounds a class is paired with one class of each of its
    bands (the first one, later others by hash), plausible partners of another label are confirmed, and the
    links give labels. Then all plausible pairs of a band whose labels differ are confirmed: a pair of one
    label can't change a component, so a large group isn't expanded into pairs and no link between groups is
    lost.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    marks = materialise(signatures(rows, cfg))
    sets = marks.filter("id is not null and n_shingles > 0")
    classes = sets.groupBy("k1", "k2", "n_shingles").agg(
        F.min("id").alias("id"), F.min_by(F.struct("bands", "sketch"), "id").alias("m")
    )
    classes = materialise(classes.select("id", "k1", "k2", "n_shingles", "m.bands", "m.sketch"))
    banded = classes.select("id", F.posexplode("bands").alias("band", "h")).select("id", F.xxhash64("band", "h").alias("h"))
    shared = banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    met = banded.join(shared, "h", "left_semi").join(classes.select("id", F.col("n_shingles").alias("n"), "sketch"), "id")
    met = materialise(met.select("h", F.col("id").alias("y"), "n", "sketch"))

    links, labels = None, None
    for k in range(cfg.rounds):
        members = _labelled(met, labels)
        turn = F.col("y") if k == 0 else F.xxhash64(F.lit(k), "h", "y")
        heads = members.groupBy("h").agg(F.min(F.struct(turn.alias("turn"), "y", "n", "sketch", "label")).alias("x"))
        other = (F.col("label") != F.col("x.label")) & plausible(F.col("n"), F.col("sketch"), F.col("x.n"), F.col("x.sketch"), cfg)
        pairs = members.join(heads, "h").filter(other).groupBy("y").agg(F.collect_set("x.y").alias("xs"))
        few = pairs.select(F.explode(F.slice(F.array_sort("xs"), 1, cfg.partners)).alias("x"), "y")
        found = materialise(confirm(few, rows, cfg))
        links = found if links is None else links.unionAll(found)
        labels = components(links.selectExpr("x as u", "y as v"))
        if found.isEmpty():
            break

    members = _labelled(met, labels)
    mixed = members.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("h")
    members = members.join(mixed, "h", "left_semi").select("h", "label", "y", "n", "sketch")
    members = members.repartition("h").sortWithinPartitions("h", "label", "y")
    rest = materialise(members.mapInArrow(lambda it: _remaining(it, cfg), "h long, x long, y long, label long"))
    few = rest.filter("x is not null").select("x", "y").distinct()
    more = confirm(few, rows, cfg).unionAll(compare_blocks(rest.filter("x is null").select("h", "y", "label"), rows, cfg))
    labels = materialise(components(links.unionAll(more).selectExpr("x as u", "y as v")))

    by_class = classes.join(labels, classes.id == labels.node, "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "id").alias("c")
    )
    moved = sets.join(by_class, ["k1", "k2", "n_shingles"]).select("id", "n_shingles", "c")
    alone = marks.filter("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("c"))
    return moved.unionAll(alone).select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("c").alias("component_id"),
        F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"),
    )


def _with_row_ids(named: DataFrame) -> DataFrame:
    """``named`` (_row, doc_id, t1, t2) with one row for each id and text, and an id ``u`` of its own for each: the doc_id
    for one text of an id, a number beyond all ids for its other texts."""
    again = materialise(named.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2")).alias("first")).filter("n > 1"))
    if again.isEmpty():
        return named.withColumn("u", F.col("doc_id"))
    maybe, clear = split_by_keys(named, "doc_id", again.select("doc_id"))
    text = Window.partitionBy("doc_id", "t1", "t2").orderBy(F.xxhash64("_row"))
    same = maybe.join(again, "doc_id").withColumn("_k", F.row_number().over(text)).filter("_k = 1")
    same = materialise(same.select("_row", "doc_id", "t1", "t2", (F.struct("t1", "t2") == F.col("first")).alias("is_first"), F.monotonically_increasing_id().alias("k")))
    low, high = named.agg(F.min("doc_id"), F.max("doc_id")).first()
    room = high < (1 << 63) - (1 << 61)
    other = F.lit(high + 1) + F.col("k") if room else F.lit(low - 1) - F.col("k")
    same = same.withColumn("u", F.when(F.col("is_first"), F.col("doc_id")).otherwise(other)).drop("is_first", "k")
    single = maybe.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(clear).withColumn("u", F.col("doc_id"))
    return materialise(single.unionByName(same))


def without_near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Rows are judged by id and text: of rows that repeat both, one stays (the same one in every run, by a hash of all its
    columns); another text under an id is a document of its own, which stays unless it is near another one. The row of
    the smallest id of a group stays. Rows with a null id, and those without words, stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.col("_row.text")
    named = docs.select(row).withColumns({"doc_id": F.col("_row.doc_id").cast("long"), "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)})
    rows = _with_row_ids(named)
    found = near_duplicates(rows.select(F.col("u").alias("doc_id"), text.alias("text")), cfg)
    gone = materialise(found.filter("not kept").select(F.col("doc_id").alias("u")))
    maybe, clear = split_by_keys(rows, "u", gone)
    kept = maybe.join(gone, "u", "left_anti").select("_row").unionAll(clear.select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
