"""Prefix trie of conversations: MSD radix partitioning over dictionary-encoded turns, multikey quicksort in buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise
from .tables import join_counted

__all__ = ["TrieConfig", "encoded", "prefix_trie", "rebuilt"]


@dataclass(frozen=True)
class TrieConfig:
    """A turn's number is read in digits of ``digit`` bits. A bucket of at most ``local`` turns, or of one sequence, is
    finished in a task; neither changes a result. ``chunk`` ids are joined at a time for ends_sha256."""

    digit: int = 12
    local: int = 1 << 14
    chunk: int = 1 << 16


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, words): the turns of each conversation in order as numbers of a dictionary, with their words.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Order: turn (null first), then the MD5 of role
    and text, so that turns of one number have a fixed order too. A null role or text is empty; rows with a null conv_id
    take no part. Equal turns are told by 128 bits. Repeated rows are turns of their own.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("given"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))).alias("key"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    rows = materialise(rows)
    book = materialise(rows.groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    # numbers without gaps: the tasks' counts, summed over a row for each task
    part = F.shiftright("id", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = book.groupBy(part).agg(F.count(F.lit(1)).alias("k")).withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    book = book.withColumn("part", part).join(F.broadcast(starts), "part")
    book = book.select("key", "n", (F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("id"))
    out = join_counted(rows, book, "key", "n", rows.count())
    turn = F.struct("given", "turn", "key", "id", "words")
    out = out.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return out.select("conv_id", F.col("t.id").alias("seq"), F.col("t.words").alias("words"))


def rebuilt(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversation c begins with the first h = crc32(c) % ``heads`` turns of conversation c - c % ``every`` (all if it has
    fewer, none if it is absent), then has its own turns after the first h."""
    first = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, heads).alias("s"), F.slice("words", 1, heads).alias("w"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).cast("int")
    out = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")

    def spliced(own: str, other: str) -> Column:
        tail = F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
        return F.concat(F.when(F.col(other).isNotNull(), F.slice(F.col(other), F.lit(1), F.col("h"))).otherwise(F.slice(F.col(own), 1, 0)), tail)

    return out.select("conv_id", spliced("seq", "s").alias("seq"), spliced("words", "w").alias("words"))


def _classes(convs: DataFrame, cfg: TrieConfig) -> DataFrame:
    """(m, n, ends): smallest id and number of the conversations of one sequence, and the SHA-256 of their ids.

    Ids are range-sorted by (sequence, id), so a frequent sequence is spread over tasks; each task joins runs of ids into
    pieces of bounded size, and one pass over a sequence's pieces hashes them."""
    key = F.md5(F.encode(F.array_join(F.transform("seq", lambda x: x.cast("string")), ","), "UTF-8"))
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = convs.select(F.unhex(key).alias("k"), "conv_id").repartitionByRange(parts, "k", "conv_id").sortWithinPartitions("k", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            runs = [(s, min(s + cfg.chunk, e)) for a, e in zip(cuts, cuts[1:]) for s in range(a, e, cfg.chunk)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[s] for s, _ in runs], pa.binary()), pa.array([ids[s] for s, _ in runs], pa.int64()), pa.array([e - s for s, e in runs], pa.int64()), pa.array([",".join(map(str, ids[s:e])) for s, e in runs], pa.string())],
                names=["k", "m", "n", "ids"],
            )

    joined = members.mapInArrow(pieces, "k binary, m long, n long, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, n, state = None, 0, 0, None
        for b in batches:
            out = []
            for k, first, count, ids in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if state is not None:
                        out.append((m, n, state.hexdigest()))
                    key, m, n, state = k, first, 0, hashlib.sha256()
                else:
                    state.update(b",")
                n += count
                state.update(ids.encode())
            yield _records(out, _CLASS)
        if state is not None:
            yield _records([(m, n, state.hexdigest())], _CLASS)

    return joined.repartition("k").sortWithinPartitions("k", "m").mapInArrow(hashed, "m long, n long, ends string")


_CLASS = pa.schema([("m", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
#: Nodes (kind 0) and what a bucket adds to the node above it (kind 1, by hm and hp): children, leaves, tokens, the class that ends there.
_NODE = pa.schema([("kind", pa.int32()), ("hm", pa.int64()), ("hp", pa.int64()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_m"))])
_NODE_SQL = "kind int, hm long, hp long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_m long"


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _finished(table: pa.Table) -> pa.Table:
    """All nodes of a bucket below the prefix that its sequences share, by multikey quicksort: sequences are split in three
    by the pivot's turn; those equal to it are a node and go on with the next turn."""
    hm, hp, start, owner = (table[c][0].as_py() for c in ("hm", "hp", "depth", "om"))
    seqs = [np.asarray(x, np.int64) for x in table["seq"].to_pylist()]
    words = table["words"].to_pylist()
    n, m = table["n"].to_pylist(), table["m"].to_pylist()
    nodes: list[list] = []  # conv_id, depth, parent (index), n_convs, children, leaves, saved, end_m
    top = [0, 0, 0, None]  # children, leaves, saved and end of the prefix itself
    stack: list[tuple[list[int], int, int]] = [(list(range(len(seqs))), start, -1)]
    while stack:
        rows, d, parent = stack.pop()
        ended = [i for i in rows if len(seqs[i]) == d]
        if ended:  # sequences are distinct
            if parent < 0:
                top[3] = m[ended[0]]
            else:
                nodes[parent][7] = m[ended[0]]
            rows = [i for i in rows if len(seqs[i]) > d]
        if not rows:
            continue
        turn = np.array([seqs[i][d] for i in rows])
        pivot = turn[len(turn) // 2]
        for side in (turn < pivot, turn > pivot):
            if side.any():
                stack.append(([rows[i] for i in np.flatnonzero(side)], d, parent))
        same = [rows[i] for i in np.flatnonzero(turn == pivot)]
        count = sum(n[i] for i in same)
        nodes.append([min(m[i] for i in same), d + 1, parent, count, 0, 0, (count - 1) * words[same[0]][d], None])
        if parent < 0:
            top[0] += 1
        else:
            nodes[parent][4] += 1
        stack.append((same, d + 1, len(nodes) - 1))
    for node in reversed(nodes):  # a parent stands before its children
        node[5] += node[4] == 0
        if node[2] < 0:
            top[1] += node[5]
            top[2] += node[6]
        else:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    out = [(0, hm, hp, v[0], v[1], owner if v[2] < 0 else nodes[v[2]][0], *v[3:]) for v in nodes]
    out.append((1, hm, hp, None, None, None, None, *top))
    return pa.Table.from_batches([_records(out, _NODE)])


def _split(rows: DataFrame, digits: int, width: int) -> DataFrame:
    """The next digit of each sequence at the position ``hp`` of its digits; -1 where it has ended."""
    shift = f"cast({width} * ({digits} - 1 - hp % {digits}) as int)"
    digit = F.expr(f"shiftright(element_at(seq, cast(hp div {digits} as int) + 1), {shift})").bitwiseAND((1 << width) - 1)
    ended = F.expr(f"hp div {digits} >= size(seq)")
    return rows.withColumn("digit", F.when(ended, F.lit(-1)).otherwise(digit).cast("long"))


def _shared(digits: int, width: int) -> tuple[Column, Column]:
    """Whole turns, and digits, that the least and the greatest sequence of a bucket share (so all of it shares them)."""
    both = "least(size(lo), size(hi))"
    turns = F.expr(f"coalesce(array_min(filter(sequence(0, {both}), i -> i < {both} and get(lo, i) <> get(hi, i))), {both})")
    same = [f"cast(shiftright(get(lo, turns), {width * (digits - 1 - j)}) = shiftright(get(hi, turns), {width * (digits - 1 - j)}) as int)" for j in range(digits - 1)]
    return turns.cast("int"), F.expr(f"cast(turns * {digits} + if(turns < {both}, {' + '.join(same) or '0'}, 0) as long)")


def prefix_trie(convs: DataFrame, cfg: TrieConfig = TrieConfig()) -> DataFrame:
    """A row for each distinct prefix of the sequences of ``convs`` (conv_id, seq, words): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal sequences are one sequence of their smallest id from the start. Buckets share a prefix; one that is too large
    for a task is dealt by its next digit, after what all its sequences share has been skipped. Its own node is told by
    the bucket's sums. Buckets that are small enough are finished where they are, and add their children, leaves and saved
    tokens to the nodes above. An empty table has no node, a conversation without turns is a member of the root.
    """
    spark = convs.sparkSession
    convs = materialise(convs.select("conv_id", "seq", "words"))
    classes = materialise(_classes(convs, cfg))
    total = classes.agg(F.sum("n"), F.min("m")).first()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not total[0]:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in names))
    most = convs.agg(F.max(F.array_max("seq"))).first()[0] or 0
    bits = max(1, int(most).bit_length())
    digits = -(-bits // cfg.digit)
    width = -(-bits // digits)
    rows = classes.select("m", "n").join(convs.withColumnRenamed("conv_id", "m"), "m")
    state = {"hm": F.lit(total[1]), "hp": F.lit(0).cast("long"), "om": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "digit": F.lit(0).cast("long")}
    rows = materialise(rows.withColumns(state))
    hot, local, above = None, [], None
    while True:
        # rows lie in buckets (hm, hp, digit); the first bucket holds all of them and is always taken apart
        size = F.sum(F.size("seq").cast("long") + 1)
        sums = rows.groupBy("hm", "hp", "digit").agg(size.alias("size"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_convs"), F.min("m").alias("bm"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min(F.struct("m", "words")).alias("w"))
        large = sums if above is None else sums.filter((F.col("size") > cfg.local) & (F.col("k") > 1))
        turns, shared = _shared(digits, width)
        large = large.withColumn("turns", turns).withColumn("p", shared)
        if above is None:
            large = large.select("hm", "hp", "digit", "n_convs", "bm", "turns", "p", F.lit(-1).cast("long").alias("from"), F.col("w.words").alias("words"), F.lit(None).cast("long").alias("pm"), F.lit(None).cast("long").alias("pp"), F.array().cast("array<struct<m:long,p:long>>").alias("up"), F.lit(None).cast("long").alias("parent"))
        else:
            large = large.join(above, ["hm", "hp"]).select("hm", "hp", "digit", "n_convs", "bm", "turns", "p", F.col("turns_above").alias("from"), F.col("w.words").alias("words"), F.col("hm").alias("pm"), F.col("hp").alias("pp"), "up", F.col("om_above").alias("parent"))
        large = large.withColumn("om", F.when(F.col("turns") > F.col("from"), F.col("bm")).otherwise(F.col("parent")))
        large = materialise(large.withColumn("up", F.array_append("up", F.struct(F.col("bm").alias("m"), F.col("p").alias("p")))))
        count = large.count()
        if not count:
            local.append(rows)
            break
        hot = large if hot is None else hot.unionByName(large)
        place = large.select("hm", "hp", "digit", F.col("bm").alias("hm2"), F.col("p").alias("hp2"), F.col("om").alias("om2"), F.col("turns").alias("depth2"))
        place = F.broadcast(place) if count <= 1 << 16 else place
        keys = ["hm", "hp", "digit"]
        if above is not None:
            local.append(rows.join(place.select(keys), keys, "left_anti"))
        rows = rows.join(place, keys).select("m", "n", "seq", "words", F.col("hm2").alias("hm"), F.col("hp2").alias("hp"), F.col("om2").alias("om"), F.col("depth2").alias("depth"))
        rows = materialise(_split(rows, digits, width))
        above = large.select(F.col("bm").alias("hm"), F.col("p").alias("hp"), F.col("turns").alias("turns_above"), F.col("om").alias("om_above"), "up")
    small = local[0]
    for x in local[1:]:
        small = small.unionByName(x)
    done = materialise(small.groupBy("hm", "hp", "digit").applyInArrow(_finished, _NODE_SQL))
    nodes = done.filter("kind = 0").select(*names[:-1], "end_m").unionByName(_upper(hot, done.filter("kind = 1")))
    ends = classes.select(F.col("m").alias("end_m"), "ends")
    out = nodes.join(ends, "end_m", "left").withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)))
    return out.select(*names)


def _upper(hot: DataFrame, added: DataFrame) -> DataFrame:
    """The nodes of buckets that were taken apart: a bucket's new node, and those of one child each on the way to it."""
    me = ["bm", "p"]
    own = F.aggregate(F.slice("words", F.greatest(F.col("from"), F.lit(0)).cast("int") + 1, (F.col("turns") - F.greatest(F.col("from"), F.lit(0))).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    hot = materialise(hot.withColumn("own", (F.col("n_convs") - 1) * own))
    # leaves and saved tokens of finished buckets go to all buckets above, children and ends to the nearest one with a node
    gain = added.select(F.col("hm").alias("bm"), F.col("hp").alias("p"), "n_children", "n_leaves", "saved_tokens", "end_m").groupBy("bm", "p").agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("end_m").alias("end_m"))
    joined = hot.join(gain, me, "left")
    leaves, saved = F.coalesce("n_leaves", F.lit(0)), F.coalesce("saved_tokens", F.lit(0))
    every = joined.select("bm", "p", "own", leaves.alias("l"), saved.alias("s"), F.explode("up").alias("a"))
    mine = (F.col("a.m") == F.col("bm")) & (F.col("a.p") == F.col("p"))
    below = every.groupBy(F.col("a.m").alias("bm"), F.col("a.p").alias("p")).agg(F.sum("l").alias("leaves"), F.sum(F.col("s") + F.when(mine, 0).otherwise(F.col("own"))).alias("below"))
    # the bucket whose node a bucket belongs to: itself, or the nearest one above with a node of its own
    fresh = F.col("turns") > F.col("from")
    owner = hot.filter(fresh).select(F.col("om").alias("no"), F.col("turns").alias("nd"), F.col("bm").alias("obm"), F.col("p").alias("op"))
    at = joined.select(F.col("om").alias("no"), F.col("turns").alias("nd"), F.coalesce("n_children", F.lit(0)).alias("c"), "end_m")
    grown = hot.filter(fresh & F.col("pm").isNotNull()).select(F.col("parent").alias("no"), F.col("from").alias("nd"), F.lit(1).cast("long").alias("c"), F.lit(None).cast("long").alias("end_m"))
    at = at.unionByName(grown).groupBy("no", "nd").agg(F.sum("c").alias("kids"), F.max("end_m").alias("end_m"))
    at = at.join(owner, ["no", "nd"]).select(F.col("obm").alias("bm"), F.col("op").alias("p"), "kids", "end_m")
    out = hot.filter(fresh).join(below, me).join(at, me, "left").withColumn("depth", F.explode(F.sequence(F.col("from") + 1, F.col("turns"))))
    last = F.col("depth") == F.col("turns")
    word = F.expr("aggregate(slice(words, cast(greatest(depth, 1) as int), cast(turns - greatest(depth, 1) + 1 as int)), cast(0 as long), (a, x) -> a + x)")
    return out.select(
        F.col("bm").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from") + 1, F.col("parent")).otherwise(F.col("bm")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"), F.when(F.col("leaves") == 0, F.lit(1)).otherwise(F.col("leaves")).alias("n_leaves"),
        (F.col("below") + (F.col("n_convs") - 1) * word).alias("saved_tokens"), F.when(last, F.col("end_m")).alias("end_m"),
    )
