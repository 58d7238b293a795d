"""Removal of long repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut texts into phrases that overlap in a trigger's context, so where two texts agree, their cuts
agree as well. The phrases are the dictionary, their sequence is the parse. A string of ``length`` bytes is the end of a
phrase, whole phrases, and the beginning of another one. Where its whole phrases don't repeat it can't either; strings
whose ends come with them are told at once for all starts between two cuts; only what is left, at the edges of repeats,
is looked at byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, split_by_keys
from .tables import join_counted

__all__ = ["RepeatConfig", "find_triggers", "without_repeats"]

@dataclass(frozen=True)
class RepeatConfig:
    """Bytes in a string of ``length`` that starts anywhere else too go. A trigger is where the rolling hash of ``window``
    bytes is least within ``reach`` bytes to both sides (strictly to the left): triggers are more than ``reach`` bytes
    apart and ``2 * reach + window`` bytes tell whether there is one. ``window`` is a power of two; a trigger's context
    has to be shorter than ``length``. Up to ``group`` texts around the same phrases are compared in a task, more of them
    by hashes of their strings. Window, reach and group change no result."""

    length: int = 400
    window: int = 16
    reach: int = 40
    group: int = 256

    @property
    def context(self) -> int:
        return 2 * self.reach + self.window


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours (n - 1 values fewer)."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def find_triggers(data: np.ndarray, cfg: RepeatConfig) -> np.ndarray:
    """Positions of triggers whose whole context lies in ``data`` (bytes)."""
    if len(data) < cfg.context:
        return np.empty(0, np.int64)
    h, base, width = data.astype(np.uint32) + np.uint32(1), np.uint32(0x01000193), 1
    while width < cfg.window:  # sum of byte times power of the base over twice as many bytes
        h = h[:-width] * base + h[width:]
        base, width = np.uint32(int(base) ** 2 % 2**32), 2 * width
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(13)
    low, r = _least(h, cfg.reach), cfg.reach
    own = h[r : len(h) - r]
    return np.flatnonzero((own < low[: len(own)]) & (own <= low[r + 1 : r + 1 + len(own)])) + r


def _by_text(texts: pa.Array, cfg: RepeatConfig) -> Iterator[tuple[int, memoryview, np.ndarray]]:
    """(row, bytes, triggers) of each text of a batch; the triggers of all its texts are found at once."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    whole = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    starts = offsets - offsets[0]
    t = find_triggers(whole, cfg)
    row = np.searchsorted(starts, t, side="right") - 1
    inside = (t - cfg.reach >= starts[row]) & (t + cfg.reach + cfg.window <= starts[row + 1]) if len(t) else np.empty(0, bool)
    t, row = t[inside], row[inside]
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    view = memoryview(whole)
    for k in range(len(texts)):
        yield k, view[starts[k] : starts[k + 1]], t[at[k] : at[k + 1]] - starts[k]


def _lonely(t: np.ndarray, n: int, cfg: RepeatConfig) -> np.ndarray:
    """Triggers that some string has for its only one: those before and after it can both be outside."""
    before = np.concatenate([[-cfg.length], t[:-1]]) if len(t) else t
    after = np.concatenate([t[1:], [n + cfg.length]]) if len(t) else t
    # the string begins after before - reach, and ends before after + reach + window
    return np.flatnonzero(np.minimum(after + cfg.reach + cfg.window - 1, n) - np.maximum(before - cfg.reach + 1, 0) >= cfg.length)


def _has_bare(t: np.ndarray, n: int, cfg: RepeatConfig) -> bool:
    """Whether some string has no trigger."""
    edges = np.concatenate([[-1 + cfg.reach], t, [n + 1 - cfg.reach - cfg.window]])
    return n >= cfg.length and bool((edges[1:] - edges[:-1] + cfg.context - 2 >= cfg.length).any())


def _digest(data: memoryview, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _long(data: memoryview) -> int:
    return int.from_bytes(_digest(data, 8), "little", signed=True)


def _parse(cfg: RepeatConfig, names: list[str]):
    """Each text with its size, its checksum and the hashes of its phrases and lonely triggers."""
    x = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sums, parts, bare = [], [], [], []
            for _, text, t in _by_text(b.column(x), cfg):
                r, e = cfg.reach, cfg.reach + cfg.window
                at = t.tolist()
                phrases = [_long(text[p - r : q + e]) for p, q in zip(at, at[1:])]
                alone = [_long(text[at[k] - r : at[k] + e]) for k in _lonely(t, len(text), cfg).tolist()]
                sizes.append(len(text))
                sums.append(hashlib.sha256(text).hexdigest())
                parts.append(phrases + alone if len(text) >= cfg.length else [])
                bare.append(_has_bare(t, len(text), cfg))
            more = [pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(parts, pa.list_(pa.int64())), pa.array(bare, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "n_bytes", "sha", "parts", "bare"])
        release()

    return run


_STRETCHES = pa.schema([("u", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("lead", pa.int64()), ("body", pa.int64()), ("mid", pa.binary()), ("full", pa.binary())])
_STRETCH = "u long, i long, n long, lead long, body long, mid binary, full binary"


def _stretches(cfg: RepeatConfig):
    """Starts between two cuts, for which the same triggers are inside: the first, their number, the bytes before the first
    trigger and from it to the last, a hash of these last ones, and of all bytes of these strings. Only those whose phrases all repeat; without a trigger
    ``mid`` and ``full`` are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, e, size = cfg.reach, cfg.reach + cfg.window, cfg.length
        for b in batches:
            out: list[tuple] = []
            us, known = b.column(0).to_pylist(), b.column(2)
            for k, text, t in _by_text(b.column(1), cfg):
                n = len(text)
                if n < size:
                    continue
                alone = _lonely(t, n, cfg)
                seen = np.zeros(max(len(t) - 1, 0) + len(alone), bool)
                found = known[k].as_py()
                if found:
                    seen[found] = True
                phrases = np.concatenate([[0], np.cumsum(~seen[: max(len(t) - 1, 0)])])
                single = np.zeros(len(t), bool)
                single[alone] = seen[max(len(t) - 1, 0) :]
                starts = np.unique(np.concatenate([[0], t - r + 1, t + e - size]))
                starts = starts[(starts >= 0) & (starts <= n - size)]
                first, last = np.searchsorted(t, starts + r), np.searchsorted(t, starts + size - e, side="right") - 1
                count = np.diff(np.concatenate([starts, [n - size + 1]]))
                f, z = np.minimum(first, max(len(t) - 1, 0)), np.maximum(last, 0)
                keep = first > last
                if len(t):
                    keep = keep | np.where(first == last, single[f], (first < last) & (phrases[np.minimum(z, len(phrases) - 1)] == phrases[np.minimum(f, len(phrases) - 1)]))
                for i, c, p, q in zip(starts[keep].tolist(), count[keep].tolist(), first[keep].tolist(), last[keep].tolist()):
                    if p > q:
                        out.append((us[k], i, c, 0, 0, None, None))
                    else:
                        a, z = int(t[p]) - r, int(t[q]) + e
                        out.append((us[k], i, c, a - i, z - a, _digest(text[a:z], 16), _digest(text[i : i + c - 1 + size], 16)))
            yield _records(out, _STRETCHES)
        release()

    return run


#: A string's hash, or else the bytes to both sides of the phrases that a stretch has in common with others.
_ENDS = "h binary, u long, i long, n long, open boolean, mid binary, left binary, right binary"
_END = pa.schema([("h", pa.binary()), ("u", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()), ("mid", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
_FOUND = pa.schema([("u", pa.int64()), ("i", pa.int64()), ("n", pa.int64())])


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ends(cfg: RepeatConfig):
    """For each stretch of a text its bytes to both sides; where ``one`` is set, a row with a hash for each of its strings.
    ``open``: whether the fate of its starts is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = cfg.length
        for b in batches:
            for u, text, stretches in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), b.column(2)):
                data, out = memoryview(text.as_buffer()), []
                for s in stretches.as_py():
                    i, n = s["i"], s["n"]
                    if not s["one"]:
                        a = i + s["lead"]
                        out.append((None, u, i, n, s["open"], s["mid"], bytes(data[i:a]), bytes(data[a + s["body"] : i + n - 1 + size])))
                        continue
                    for k in range(i, i + n):
                        out.append((_digest(data[k : k + size], 16), u, k, 1, s["open"], None, None, None))
                        if len(out) >= 4096:
                            yield _records(out, _END)
                            out = []
                yield _records(out, _END)
        release()

    return run


def _twice(members: list[tuple]) -> list[tuple]:
    """Open starts (u, i, n) of stretches around the same phrases whose strings some other of them has too: ends of the
    bytes before, with beginnings of the bytes after."""
    count: dict[tuple[bytes, bytes], int] = {}
    keys = []
    for _, _, n, _, left, right in members:
        least = len(right) - n + 1
        own = [(left[j:], right[: least + j]) for j in range(n)]
        for key in own:
            count[key] = count.get(key, 0) + 1
        keys.append(own)
    out = []
    for (u, i, n, is_open, _, _), own in zip(members, keys):
        if is_open:
            out += [(u, i + j, 1) for j in range(n) if count[own[j]] > 1]
    merged: list[tuple] = []
    for u, i, n in out:
        if merged and merged[-1][0] == u and merged[-1][1] + merged[-1][2] == i:
            merged[-1] = (u, merged[-1][1], merged[-1][2] + n)
        else:
            merged.append((u, i, n))
    return merged


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_twice`` for each run of rows with the same phrases (mid); rows come in order of it."""
    mid, members = None, []
    for b in batches:
        out: list[tuple] = []
        for m, *row in zip(*(c.to_pylist() for c in b.columns)):
            if m != mid:
                out += _twice(members)
                mid, members = m, []
            members.append(tuple(row))
        yield _records(out, _FOUND)
    yield _records(_twice(members), _FOUND)
    release()


def _kept(cfg: RepeatConfig, names: list[str], texts: bool):
    """What is left of each text whose repeated starts are listed."""
    x, s = names.index("text"), names.index("starts")
    give = [k for k, name in enumerate(names) if name not in ("text", "starts", "sha", "parts", "bare", "u")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, sums, left = [], [], [], []
            for text, starts in zip(b.column(x).cast(pa.large_binary()), b.column(s)):
                data = text.as_py() or b""
                pieces, at, gone, runs = [], 0, 0, 0
                for p in sorted(starts.as_py() or [], key=lambda v: v["i"]):
                    i, end = p["i"], p["i"] + p["n"] - 1 + cfg.length
                    if i > at or not runs:
                        pieces.append(data[at:i])
                        runs += 1
                        at = i
                    gone += max(0, end - at)
                    at = max(at, end)
                pieces.append(data[at:])
                kept = b"".join(pieces)
                removed.append(gone)
                spans.append(runs)
                sums.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            more = [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())] + [pa.array(left, pa.binary())] * texts
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in give), *more], names=[*(names[k] for k in give), "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])
        release()

    return run


def repeated_starts(parsed: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """(u, i, n): n starts from byte i of text u on whose strings start elsewhere too; ``parsed`` is a written table."""
    phrases = parsed.select("u", F.posexplode("parts").alias("k", "part"))
    book = materialise(phrases.groupBy("part").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    total = parsed.agg(F.sum(F.size("parts"))).first()[0] or 0
    known = join_counted(phrases, book, "part", "c", total).groupBy("u").agg(F.collect_list("k").alias("known"))
    known = known.unionByName(parsed.filter("bare").select("u", F.array().cast("array<int>").alias("known"))).groupBy("u").agg(F.flatten(F.collect_list("known")).alias("known"))
    known = materialise(known)
    may, _ = split_by_keys(parsed.select("u", "text"), "u", known.select("u"))
    found = materialise(may.join(known, "u").select("u", "text", "known").mapInArrow(_stretches(cfg), _STRETCH))
    classes = materialise(found.filter("full is not null").groupBy("full", "mid").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("u", "i", "n", "lead", "body")).alias("one")))
    # strings that agree between their outermost triggers, but not to both ends
    mids = classes.groupBy("mid").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).filter("k > 1 and least = 1").drop("least")
    near = join_counted(classes, materialise(mids), "mid", "k", classes.count())
    near = near.select("one.*", "mid", (F.col("c") == 1).alias("open"), (F.col("k") > cfg.group).alias("one"))
    bare = found.filter("full is null").select("u", "i", "n", "lead", "body", F.lit(None).cast("binary").alias("mid"), F.lit(True).alias("open"), F.lit(True).alias("one"))
    near = materialise(near.unionByName(bare).groupBy("u").agg(F.collect_list(F.struct("i", "n", "lead", "body", "mid", "open", "one")).alias("s")))
    may, _ = split_by_keys(parsed.select("u", "text"), "u", near.select("u"))
    ends = materialise(may.join(near, "u").select("u", "text", "s").mapInArrow(_ends(cfg), _ENDS))
    sides = ends.filter("h is null").select("mid", "u", "i", "n", "open", "left", "right").repartition("mid").sortWithinPartitions("mid")
    around = sides.mapInArrow(_around, "u long, i long, n long")
    strings = ends.filter("h is not null").select("h", "u", "i", "n", "open")
    twice = materialise(strings.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    at_edges = join_counted(strings.filter("open"), twice, "h", "c", strings.count()).select("u", "i", "n")
    whole = join_counted(found.filter("full is not null").select("u", "i", "n", "full"), classes.filter("c > 1").select("full", "c"), "full", "c", found.count())
    return whole.select("u", "i", "n").unionByName(around).unionByName(at_edges)


def without_repeats(docs: DataFrame, cfg: RepeatConfig = RepeatConfig(), texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with ``texts`` what is kept (``kept``, binary:
    a cut may fall into a character).

    A byte goes if it is in a string of ``length`` bytes (of the text's UTF-8) that starts at another place of any row too,
    overlapping places included; strings are judged on the input. Null and short texts keep all their bytes; rows that
    repeat an id or a text are rows of their own, so a text of ``length`` bytes or more that is there twice goes wholly.
    Other columns are ignored. Phrases are told apart by 64 bits, which only lets more through to the next step, strings
    by 128 bits.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("u"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["u", "doc_id", "text"]
    parsed = materialise(rows.mapInArrow(_parse(cfg, names), f"u long, doc_id {kind}, text string, n_bytes long, sha string, parts array<long>, bare boolean"))
    starts = materialise(repeated_starts(parsed, cfg).groupBy("u").agg(F.collect_list(F.struct("i", "n")).alias("starts")))
    may, rest = split_by_keys(parsed, "u", starts.select("u"))
    may = may.select("u", "doc_id", "text", "n_bytes").join(starts, "u", "left")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    out = may.select("u", "doc_id", "text", "n_bytes", "starts").mapInArrow(_kept(cfg, ["u", "doc_id", "text", "n_bytes", "starts"], texts), schema)
    zero = F.lit(0).cast("long")
    same = [F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept")] * texts
    return out.unionByName(rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), *same))
