"""Line dedup: an exact set-similarity self-join of lines by prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_BUCKETS, bucket_flags, discard, materialise, release, split_by_keys
from .text import U64, chunks, mix, word_hashes

#: Cells of the table of token classes: its size is fixed, so it can be sent to every task.
CELL_BITS = 24
#: Bits of a token's hash by which counts are dealt out, at most: each range of cells is one of 4,096 parts or fewer.
DEALT_BITS = 12
#: Tokens whose classes are told apart in that table, at most; the other tokens that occur twice share one class.
FREQUENT = 1 << 20
#: Tokens that a task gathers before it counts them.
GATHERED = 1 << 20
#: Sets of several lines that every task is told, at most, those of most lines first: their later copies are left out early.
COPIED = 1 << 18
#: Open lines that are sent to every task, at most; beyond that the buckets' rows are shuffled to them.
OPEN_SENT = 1 << 17
#: Signatures in one part of the join.
PART_ROWS = 1 << 18
#: Signatures that a task holds before it deals them out.
HELD_ROWS = 1 << 18
#: Bytes of text that a task works on at a time.
GROUP_BYTES = 1 << 18
#: Lines of more tokens share single tokens only; lines from this down to a fifth less do both.
LONG_LINE = 512
#: Lines of more tokens pair neighbours among their frequent tokens; lines up to this pair each with each.
PAIRED = 15
#: Bits of the parity bitmap of a line's tokens.
_BITS = 128
#: Lines of no more tokens than this have a bitmap of half the bits: both halves in one.
FOLDED = 64
#: The bits of its hash that a signature has. Where two agree in these, lines are compared for nothing.
_SIG = U64(0xFFFFFFFFFFFF0000)
#: One signature of a line: the line is known by its place and a part of its key.
_SIGNED = np.dtype([("sig", "<i8"), ("doc", "<i8"), ("low", "<i8"), ("high", "<i8"), ("line", "<i4"), ("key", "<i4"), ("n", "<u2"), ("pos", "<u2")])


@dataclass(frozen=True)
class LineDedupConfig:
    """A line of at least ``least`` distinct tokens whose set has ``percent`` of Jaccard similarity or more with an
    earlier line's set is removed. A token in more lines than ``hot`` only counts with a second one, so that buckets
    stay small. In the first round a line is compared with the first ``head`` lines of its buckets, which should be
    more than ``hot``; a task of the second round holds ``block`` lines. None of these three changes a result.
    """

    percent: int = 80
    least: int = 1
    hot: int = 512
    head: int = 1024
    block: int = 4096


def _by_line(line: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """The order by line and then by a key of so many bits, in one sort where the line numbers leave room."""
    if len(line) and int(line[-1]) >> (64 - bits):
        return np.lexsort((key, line))
    return np.argsort(line.astype(np.uint64) << U64(bits) | key)


class Lines:
    """The distinct tokens of the lines of some texts, by line and then hash; with ``cells``, by line, class and hash."""

    def __init__(self, texts: list[bytes], cells: np.ndarray | None = None) -> None:
        raw = b"\n".join(texts)
        h, start, _ = word_hashes(raw)
        line = np.cumsum(np.frombuffer(raw, np.uint8) == 10, dtype=np.int64)[start]
        kind = None if cells is None else cells[(h >> U64(64 - CELL_BITS)).astype(np.int64)]
        key = h >> U64(20) if kind is None else kind.astype(np.uint64) << U64(36) | h >> U64(28)
        order = _by_line(line, key, 44)
        h, line, key = h[order], line[order], key[order]
        alike = (key[1:] == key[:-1]) & (line[1:] == line[:-1])
        if (alike & (h[1:] != h[:-1])).any():  # hashes that agree in the bits of the key
            order = order[np.lexsort((h, key, line))]
            h, line = h[np.lexsort((h, key, line))], line
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, self.line = h[new], line[new]
        self.kind = None if kind is None else kind[order][new]
        counts = np.array([t.count(b"\n") + 1 for t in texts])
        first = np.concatenate([[0], np.cumsum(counts)])
        self.text_of = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(first[-1]) - np.repeat(first[:-1], counts)
        self.n = np.bincount(self.line, minlength=first[-1])

    def keep(self, least: int) -> np.ndarray:
        """Drop the tokens of lines of fewer than ``least``; the lines that are left, and their first tokens."""
        if least > 1:
            ok = self.n[self.line] >= least
            self.h, self.line, self.kind = self.h[ok], self.line[ok], None if self.kind is None else self.kind[ok]
        lines = np.flatnonzero(self.n >= max(least, 1))
        starts = np.cumsum(self.n[lines]) - self.n[lines]
        return lines, starts


def _keys(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.add.reduceat(h, starts).view(np.int64), np.add.reduceat(mix(h ^ U64(0x5555)), starts).view(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens in the prefix of a set of n: two sets that are similar enough share one of their prefixes' tokens."""
    return n - (percent * n + 99) // 100 + 1


def line_signatures(h: np.ndarray, cell: np.ndarray, starts: np.ndarray, n: np.ndarray, hot: int, rare: bool, cfg: LineDedupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of lines (index, signature, position of its first token): similar lines share one.

    Tokens come ordered by rarity (the class of their cell), ties by hash. The rarest token that two similar lines
    share is in the prefix of both, and the second one in both prefixes lengthened by one token. So a rare token is a
    signature by itself; one of a class above ``hot`` (and, without ``rare``, one of the shared class) is a signature
    with each token behind it in the lengthened prefix. A token of a single line is none. Sets of fewer tokens than
    can differ and be similar have no signature: only equal sets are similar to them.

    In lines of more than PAIRED tokens these pairs would grow with the square of the prefix once most tokens are
    frequent. There such a token is a signature with the next token only, in a longer prefix. Where two lines share
    none of the rarer tokens, their shared tokens are among the frequent ones at their ends. Of a line's neighbours
    there, one of its own tokens that the other lacks parts two pairs, and one of the other's tokens parts one. With
    a and b such tokens, n - a >= percent * (n + b) / 100 leaves 2a + b at most, which is greatest for the most a; and
    the rarer tokens are among the a. So the first pair that isn't parted is within so many in both lines.
    """
    row = np.repeat(np.arange(len(starts)), n)
    pos = np.arange(len(h)) - starts[row]
    first = prefix_length(n, cfg.percent)
    second = np.minimum(n, first + 1)
    inside = (pos < first[row]) & (cell > 0) & ((100 - cfg.percent) * (n[row] + 1) >= 100)
    alone = (cell <= hot) & (rare | (cell > 1))
    rows, sigs, places = [], [], []
    single = np.flatnonzero(inside & alone & (n[row] <= LONG_LINE * 5 // 4))
    rows.append(row[single])
    sigs.append(mix(h[single]))
    places.append(pos[single])
    long = np.flatnonzero(inside & (n[row] > LONG_LINE * 4 // 5 - 1))
    rows.append(row[long])
    sigs.append(mix(h[long] ^ U64(0x77777777)))
    places.append(pos[long])
    near = cfg.percent >= 60  # below that two similar lines may have no neighbours in common
    at = np.flatnonzero(inside & ~alone & (n[row] <= (PAIRED if near else LONG_LINE * 5 // 4)))
    step = 1
    while len(at):
        at = at[pos[at] + step < second[row[at]]]
        rows.append(row[at])
        sigs.append(mix(h[at] * U64(3) + mix(h[at + step])))
        places.append(pos[at])
        step += 1
    if near:
        own = first - 1
        parted = 2 * own + np.maximum(100 * (n - own) // cfg.percent - n, 0)
        rarer = np.bincount(row[(cell == 0) | alone], minlength=len(starts))
        ends = parted + 1 - rarer  # the last pair's place: rarer tokens are before, and part no pairs
        asked = (n > PAIRED * cfg.percent // 100) & (n <= LONG_LINE * 5 // 4)
        ok = (cell > 0) & ~alone & asked[row] & (pos < ends[row]) & (pos + 1 < n[row])
        at = np.flatnonzero(ok & ~((n[row] <= PAIRED) & (pos < first[row]) & (pos + 1 < second[row])))
        rows.append(row[at])
        sigs.append(mix(h[at] * U64(3) + mix(h[at + 1])))
        places.append(pos[at])
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(places)


def sketches(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of n lines: their unequal bits are at most the lines' unequal tokens. Those of short lines have
    both halves in the first."""
    odd = np.bincount(row * _BITS + (h % U64(_BITS)).astype(np.int64), minlength=n * _BITS) & 1
    halves = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, 2)
    short = np.bincount(row, minlength=n) <= FOLDED
    return np.where(short, halves[:, 0] ^ halves[:, 1], halves[:, 0]), np.where(short, 0, halves[:, 1])


def _groups(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with their texts; only a few hundred texts of a batch are Python objects at a time."""
    for top in range(0, b.num_rows, 256):
        texts = [(t or "").encode("utf-8") for t in b.column(column).slice(top, 256).to_pylist()]
        start = top
        for group in chunks(texts, lambda t: len(t) + 1, GROUP_BYTES):
            yield b.slice(start, len(group)), group
            start += len(group)


def packed(rows: np.ndarray) -> bytes:
    """Structured rows in fewer bytes, behind their number: all first bytes, then all second ones and so on. Many are
    alike from row to row (high bytes of numbers, places of one document), which a codec only finds when they adjoin."""
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.itemsize).T.tobytes()
    return len(rows).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """The rows of packed() blobs, one after the other."""
    counts = [int.from_bytes(x[:8], "little") for x in blobs]
    out = np.empty(sum(counts), kind)
    flat, top = out.view(np.uint8).reshape(len(out), kind.itemsize), 0
    for blob, n in zip(blobs, counts):
        planes = pa.Codec("zstd").decompress(memoryview(blob)[8:], decompressed_size=n * kind.itemsize)
        flat[top : top + n] = np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T
        top += n
    return out


_SEEN = "rid long, doc long, line int, k1 long, k2 long, range int, counts binary"
#: How often a token is in a part: 32 bits of its hash below those of the part, and the count.
_COUNT = np.dtype([("low", "<u4"), ("n", "<u2")])


def _summed(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(low, kind="stable")
    low, n = low[order], n[order]
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.empty(0, np.int64)
    return low[starts], np.add.reduceat(n, starts) if len(starts) else n


def _occurrences(rows: DataFrame, bits: int, cfg: LineDedupConfig) -> DataFrame:
    """rid, doc, line, k1, k2 of every line that is long enough; and (range, counts): in how many of a task's lines
    the tokens are whose hashes begin with these ``bits`` bits. Tokens that agree in 32 bits more are counted together."""
    names = [f.split()[0] for f in _SEEN.split(", ")]

    def dealt(token: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        out = np.empty(len(token), _COUNT)
        out["low"], out["n"] = token, np.minimum(times, 65535)
        ends = np.searchsorted(token, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << U64(32))
        blobs = [(k, packed(out[a:e])) for k, (a, e) in enumerate(zip(np.append(0, ends[:-1]), ends)) if e > a]
        # a count too large for its field comes in several rows of the part
        for i in np.flatnonzero(times > 65535):
            more = np.full(int(times[i] - 1) // 65535, (token[i] & U64(0xFFFFFFFF), 65535), _COUNT)
            more["n"][-1] = times[i] - 65535 * len(more)
            blobs.append((int(token[i] >> U64(32)), packed(more)))
        none = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        for b in batches:
            for part, texts in _groups(b, 2):
                lines = Lines(texts)
                at, starts = lines.keep(cfg.least)
                k1, k2 = _keys(lines.h, starts)
                of = pa.array(lines.text_of[at])
                gathered.append(lines.h >> U64(32 - bits))
                if sum(map(len, gathered)) > GATHERED:
                    yield dealt(*np.unique(np.concatenate(gathered), return_counts=True))
                    gathered = []
                place = [*(part.column(i).take(of) for i in range(2)), pa.array(lines.number[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*place, pa.array(k1), pa.array(k2), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=names)
        if gathered:
            yield dealt(*np.unique(np.concatenate(gathered), return_counts=True))
        release()

    return rows.mapInArrow(run, _SEEN)


def _class(n: np.ndarray) -> np.ndarray:
    """Classes of counts, 0 to 255, not falling: counts to 64 by themselves, then eight to each doubling."""
    return np.where(n <= 64, n, np.minimum(64 + 8 * np.log2(np.maximum(n, 64) / 64), 255)).astype(np.uint8)


def token_cells(parts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """The table of token classes from rows (range, counts), and the least class that it tells apart.

    A token's cell is the first bits of its hash. A token of one line has no class (0). Counts are exact; from the
    least count on that at most FREQUENT tokens reach, a token's class follows its count; below it is 1. A cell has the
    highest class of its tokens: two tokens of a cell are ordered alike, which costs time and no result.
    """

    def total(of: int, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        kind = _class(n)
        low, kind = low[n > 1], kind[n > 1]
        sizes = np.bincount(kind, minlength=256)
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([low.tobytes()]), pa.array([kind.tobytes()]), pa.array([sizes.tolist()], pa.list_(pa.int64()))], names=["range", "low", "kind", "sizes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, low, n, held = None, np.empty(0, np.uint32), np.empty(0, np.int64), []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if held and (k != of or sum(map(len, held)) > 4 * GATHERED):
                    every = np.concatenate(held)
                    low, n = _summed(np.append(low, every["low"]), np.append(n, every["n"].astype(np.int64)))
                    held = []
                if k != of and len(low):
                    yield total(of, low, n)
                    low, n = low[:0], n[:0]
                of = k
                held.append(unpacked([blob.as_py()], _COUNT))
        if held:
            every = np.concatenate(held)
            low, n = _summed(np.append(low, every["low"]), np.append(n, every["n"].astype(np.int64)))
            yield total(of, low, n)
        release()

    summed = parts.repartition("range").sortWithinPartitions("range").mapInArrow(add, "range int, low binary, kind binary, sizes array<long>")
    summed = materialise(summed)
    sizes = np.zeros(256, np.int64)
    for r in summed.select(F.posexplode("sizes").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n")).collect():  # 256 rows
        sizes[r["class"]] = r["n"]
    least = 256
    while least > 2 and sizes[least - 1 :].sum() <= FREQUENT:
        least -= 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of, low, kind in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                row = np.zeros(1 << (CELL_BITS - bits), np.uint8)
                kind = np.frombuffer(kind.as_py(), np.uint8)
                at = (np.frombuffer(low.as_py(), np.uint32) >> np.uint32(32 - CELL_BITS + bits)).astype(np.int64)
                order = np.argsort(kind, kind="stable")  # of a cell's tokens the last one written is the highest
                row[at[order]] = np.where(kind >= least, kind, 1)[order]
                yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([row.tobytes()])], names=["range", "cells"])

    cells = np.zeros(1 << CELL_BITS, np.uint8)
    row = 1 << (CELL_BITS - bits)
    for r in summed.select("range", "low", "kind").mapInArrow(pack, "range int, cells binary").toLocalIterator():
        cells[r["range"] * row : (r["range"] + 1) * row] = np.frombuffer(r["cells"], np.uint8)
    discard(summed)
    return cells, least


def _signed(rows: DataFrame, cells: np.ndarray, least_class: int, parts: int, copied: pa.Table, cfg: LineDedupConfig) -> tuple[DataFrame, Broadcast]:
    """Signatures of all lines, dealt to ``parts`` parts by signature: (part, blob of rows); and what was sent to all.

    ``copied`` has (k1, k2, doc, line) of the first lines of the sets with most lines, whose other lines are left out.
    """
    hot = int(_class(np.array([cfg.hot]))[0])
    many = np.stack([c.to_numpy().astype(np.int64) for c in copied.columns], 1)
    many = many[np.lexsort((many[:, 1], many[:, 0]))]
    shared = rows.sparkSession.sparkContext.broadcast((cells, many))

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        part_of = (every["sig"].view(np.uint64) >> U64(32)).astype(np.int64) * parts >> 32
        by = part_of << 1 | (every["n"] > FOLDED)  # lines without a second half together, which packs better
        every = every[np.argsort(by.astype(np.uint16) if parts < 1 << 15 else by, kind="stable")]
        ends = np.cumsum(np.bincount(part_of, minlength=parts))
        blobs = [(k, packed(every[a:b])) for k, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blobs], pa.int64()), pa.array([x for _, x in blobs], pa.binary())], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, many = shared.value
        held: list[np.ndarray] = []
        for b in batches:
            for part, texts in _groups(b, 1):
                lines = Lines(texts, cells)
                at, starts = lines.keep(cfg.least)
                if not len(at):
                    continue
                n = lines.n[at]
                k1, k2 = _keys(lines.h, starts)
                doc, number = part.column(0).to_numpy()[lines.text_of[at]], lines.number[at]
                row, sig, pos = line_signatures(lines.h, lines.kind, starts, n, hot, least_class <= hot, cfg)
                if len(many):
                    i = np.minimum(np.searchsorted(many[:, 0], k1), len(many) - 1)
                    later = (many[i, 2] != doc) | (many[i, 3] != number)
                    stay = ~((many[i, 0] == k1) & (many[i, 1] == k2) & later)[row]
                    sig, pos, row = sig[stay], pos[stay], row[stay]
                out = np.empty(len(row), _SIGNED)
                out["sig"], out["doc"], out["line"], out["key"] = (sig & _SIG).view(np.int64), doc[row], number[row], k1[row].astype(np.int32)
                low, high = sketches(lines.h, np.repeat(np.arange(len(at)), n), len(at))
                out["low"], out["high"], out["n"], out["pos"] = low[row], high[row], np.minimum(n, 65535)[row], np.minimum(pos, 65535)
                held.append(out)
                if sum(map(len, held)) > HELD_ROWS:
                    yield deal(held)
                    held = []
        if held:
            yield deal(held)
        release()

    return rows.select("doc", "text").mapInArrow(run, "part long, blob binary"), shared


def plausible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], percent: int, at: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices at which two arrays of lines (n, low, high, position of the shared token) may be similar, and their
    unequal bits: by length, by position (they share at most what is before the token in both, it, and what is behind
    it in both), then by bits; with ``at``, bits are those at its indices. No similar pair is refused; counts of
    65,535 and more are cut off, so those pass."""
    n = a[0] + b[0]
    ok = 100 * np.minimum(a[0], b[0]) >= percent * np.maximum(a[0], b[0])
    ok &= (100 + percent) * (np.minimum(a[3], b[3]) + np.minimum(a[0] - a[3], b[0] - b[3])) >= percent * n
    cut_off = (a[0] == 65535) | (b[0] == 65535)
    hit = np.flatnonzero(ok | cut_off)

    def pick(x: np.ndarray, of: np.ndarray | None) -> np.ndarray:
        if of is not None:
            return x[of[hit]]
        return x[hit] if len(x) == len(n) else x

    u, v = at or (None, None)
    low, high = pick(a[1], u) ^ pick(b[1], v), pick(a[2], u) ^ pick(b[2], v)
    short = np.minimum(a[0], b[0])[hit] <= FOLDED  # the other's halves are laid over each other too
    low, high = np.where(short, low ^ high, low), np.where(short, U64(0), high)
    bits = np.bitwise_count(low).astype(np.int64) + np.bitwise_count(high)
    near = ((100 + percent) * bits <= (100 - percent) * n[hit]) | cut_off[hit]
    return hit[near], bits[near]


_FOUND = "more boolean, sig long, doc long, line long, key long, xdoc long, xline long, xkey long, part long, blob binary"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _without_copies(rows: np.ndarray) -> np.ndarray:
    """Rows of the signatures that several sets have, one row (the earliest line) for each set, by signature and place."""
    sig, doc, line = (np.ascontiguousarray(rows[f]) for f in ("sig", "doc", "line"))
    order = np.argsort(sig)
    new = np.append(True, sig[order[1:]] != sig[order[:-1]])[: len(order)]
    order = order[~(new & np.append(new[1:], True)[: len(order)])]  # without signatures of their own
    if not len(order):
        return rows[:0]
    sig, doc, line = sig[order], doc[order], line[order]
    group = np.cumsum(np.append(False, sig[1:] != sig[:-1]))
    widths = [(int(x.max()) - int(x.min())).bit_length() for x in (group, doc, line)]
    if sum(widths) < 64:  # then signature and place are one number, which sorts faster
        key = group.astype(np.uint64)
        for x, width in zip((doc, line), widths[1:]):
            key = key << U64(width) | (x - x.min()).astype(np.uint64)
        at = np.argsort(key)
    else:
        at = np.lexsort((line, doc, sig))
    order, sig = order[at], sig[at]
    fields = [sig, *(np.ascontiguousarray(rows[f])[order] for f in ("key", "low", "high"))]
    mark = np.zeros(len(order), np.uint64)
    for f in fields:
        mark = mix(mark * U64(3) + f.astype(np.int64).view(np.uint64))
    at = np.argsort(mark)
    new = np.append(True, mark[at[1:]] != mark[at[:-1]])
    head = np.empty(len(order), np.int64)
    head[at] = np.minimum.reduceat(at, np.flatnonzero(new))[np.cumsum(new) - 1]
    copy = head != np.arange(len(order))
    for f in fields:
        copy &= f == f[head]
    return rows[order[~copy]]


def part_pairs(part: int, rows: np.ndarray, cfg: LineDedupConfig) -> Iterator[pa.RecordBatch]:
    """What one part's signatures say. Lines with plausible lines among their bucket's first ``head``: the earliest one
    and the one of fewest unequal bits; ``more`` tells, once for a line, whether there may be others (then xdoc can be null).
    And one blob with all rows of the buckets that have such lines."""
    rows = _without_copies(rows)
    if not len(rows):
        return
    sig = np.ascontiguousarray(rows["sig"])
    start = np.maximum.accumulate(np.where(np.append(True, sig[1:] != sig[:-1]), np.arange(len(rows)), 0))
    rank = np.arange(len(rows)) - start
    n, pos = rows["n"].astype(np.int32), rows["pos"].astype(np.int32)
    low, high = (np.ascontiguousarray(rows[f]).view(np.uint64) for f in ("low", "high"))
    hits = np.zeros(len(rows), np.int32)
    first, best = np.full(len(rows), -1), np.full(len(rows), -1)
    least = np.full(len(rows), 1 << 20)
    active = np.flatnonzero(rank > 0)
    for j in range(cfg.head):
        active = active[rank[active] > j]
        if not len(active):
            break
        at = start[active] + j
        hit, bits = plausible((n[active], low, high, pos[active]), (n[at], low, high, pos[at]), cfg.percent, (active, at))
        y, x = active[hit], at[hit]
        hits[y] += 1
        new = first[y] < 0
        first[y[new]] = x[new]
        nearer = bits < least[y]
        best[y[nearer]], least[y[nearer]] = x[nearer], bits[nearer]
    kept = [(np.flatnonzero(best >= 0), best), (np.flatnonzero((first >= 0) & (first != best)), first)]
    several = (hits > sum(np.bincount(i, minlength=len(rows)) for i, _ in kept)) | (rank >= cfg.head)
    unknown = np.flatnonzero(several & (best < 0))
    y = np.concatenate([*(i for i, _ in kept), unknown])
    x = np.concatenate([*(other[i] for i, other in kept), np.full(len(unknown), -1)])
    more = several[y]
    more[len(kept[0][0]) : len(kept[0][0]) + len(kept[1][0])] = False  # these lines come with their best one too
    partner = [pa.array(rows[c][x].astype(np.int64), mask=x < 0) for c in ("doc", "line", "key")]
    own = [pa.array(rows[c][y].astype(np.int64)) for c in ("sig", "doc", "line", "key")]
    yield pa.RecordBatch.from_arrays([pa.array(more), *own, *partner, pa.nulls(len(y), pa.int64()), pa.nulls(len(y), pa.binary())], names=_NAMES)
    if several.any():
        many = np.bincount(start, weights=several, minlength=len(rows))[start] > 0
        none = [pa.nulls(1, pa.bool_()), *[pa.nulls(1, pa.int64())] * 7]
        yield pa.RecordBatch.from_arrays([*none, pa.array([part]), pa.array([packed(rows[many])], pa.binary())], names=_NAMES)


def _part_rows(batches: Iterator[pa.RecordBatch], cfg: LineDedupConfig) -> Iterator[pa.RecordBatch]:
    """Rows (part, blob) come sorted by part; a part is joined when its blobs are complete."""
    held, of = [], None
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if held and k != of:
                yield from part_pairs(of, unpacked(held, _SIGNED), cfg)
                held = []
            of = k
            held.append(blob.as_py())
    if held:
        yield from part_pairs(of, unpacked(held, _SIGNED), cfg)
    release()


def _line_words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, line, key, words (the line itself, which takes less room than its tokens' hashes) of the lines in ``wanted``
    (doc, line, key)."""
    rows = split_by_keys(rows.select("doc", "text"), "doc", wanted.select("doc").distinct())[0]
    lines = rows.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    lines = lines.select("doc", F.col("line").cast("long").alias("line"), "words").withColumn("at", F.xxhash64("doc", "line"))
    near = split_by_keys(lines, "at", wanted.select(F.xxhash64("doc", "line").alias("at")))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _groups(b, 2):
                sets = Lines(texts)  # one line each
                at, starts = sets.keep(1)
                key = np.zeros(part.num_rows, np.int64)
                key[at] = _keys(sets.h, starts)[0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key), part.column(2)], names=["doc", "line", "key", "words"])
        release()

    sets = near.select("doc", "line", "words").mapInArrow(run, "doc long, line long, key long, words string")
    return sets.join(wanted, ["doc", "line", "key"], "left_semi").dropDuplicates(["doc", "line", "key"])


def _token_sets(b: pa.RecordBatch, column: int) -> Iterator[tuple[list, np.ndarray]]:
    """The rows of a batch, each with the token set of the line in a column; the line itself is not in the row."""
    for part, texts in _groups(b, column):
        sets = Lines(texts)  # one line each
        ends = np.cumsum(sets.n)
        for row, a, e in zip(zip(*(part.column(i).to_pylist() for i in range(part.num_columns) if i != column)), ends - sets.n, ends):
            yield list(row), sets.h[a:e]


def _verified(pairs: DataFrame, rows: DataFrame, cfg: LineDedupConfig) -> DataFrame:
    """The lines (doc, line, key) of pairs whose full token sets are similar enough.

    A line's set is sent to its partners' tasks, each of which holds one partner's set; a partner of many lines is
    dealt to several tasks by salt.
    """
    own, other = ["doc", "line", "key"], ["xdoc", "xline", "xkey"]
    pairs = materialise(pairs)
    salts = pairs.groupBy(*other).agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("salts"))
    dealt = pairs.join(salts.filter("salts > 1"), other, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    y = dealt.select(*own, *other, F.pmod(F.xxhash64(*own), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    x = salts.select(*[F.col(c).alias(o) for c, o in zip(other, own)], *other, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    asked = y.unionByName(x)
    sets = _line_words(rows, pairs.select(*own).unionAll(pairs.select(*other)).distinct())
    group = [*other, "salt"]
    sent = asked.join(sets, own).repartition(*group).sortWithinPartitions(*group, "role").select(*group, "role", *own, "words")
    percent = cfg.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = head = None
        for b in batches:
            out = []
            for (*at, role, doc, line, key), mine in _token_sets(b, 8):
                if role == 0:
                    of, head = at, mine
                elif of == at:
                    both = len(np.intersect1d(head, mine, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(mine) - both):
                        out.append((doc, line, key))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=own)
        release()

    return sent.mapInArrow(run, "doc long, line long, key long").distinct()


_REST = "sig long, doc long, line long, key long, xdoc long, xline long, xkey long, open boolean"


def open_pairs(rows: np.ndarray, lines: np.ndarray, cfg: LineDedupConfig) -> Iterator[pa.RecordBatch]:
    """Of a part's rows and its open lines (sig, doc, line, key): each open line with its plausible earlier lines of a
    bucket; or, where these are more than the bucket's rows that are in any such pair, those rows and whether they are
    open (xdoc is null)."""
    lines = lines[np.argsort(lines["sig"], kind="stable")]
    names = [f.split()[0] for f in _REST.split(", ")]
    sigs, first = np.unique(lines["sig"], return_index=True)
    ys, xs, dense, flags = [], [], [], []
    for sig, asked in zip(sigs, np.split(lines, first[1:])):
        lo, hi = np.searchsorted(rows["sig"], [sig, sig + 1]) if sig < np.iinfo(np.int64).max else (np.searchsorted(rows["sig"], sig), len(rows))
        bucket = rows[lo:hi]
        known = {tuple(x) for x in asked[["doc", "line", "key"]].tolist()}
        is_open = np.array([tuple(x) in known for x in bucket[["doc", "line", "key"]].tolist()], bool)
        marks = (bucket["n"].astype(np.int64), *(np.ascontiguousarray(bucket[f]).view(np.uint64) for f in ("low", "high")), bucket["pos"].astype(np.int64))
        found, met = [], is_open.copy()
        for y in np.flatnonzero(is_open):
            a, b = tuple(m[y : y + 1] for m in marks), tuple(m[:y] for m in marks)
            x = plausible(a, b, cfg.percent)[0]
            found.append((y, x))
            met[x] = True
            if sum(len(x) for _, x in found) > 16 * len(bucket):
                met[:] = True
                break
        if sum(len(x) for _, x in found) > met.sum():
            dense.append(bucket[met])
            flags.append(is_open[met])
        else:
            ys += [bucket[np.full(len(x), y)] for y, x in found]
            xs += [bucket[x] for _, x in found]

    def columns(part: np.ndarray, fields: tuple[str, ...]) -> list[pa.Array]:
        return [pa.array(part[f].astype(np.int64)) for f in fields]

    if ys:
        y, x = np.concatenate(ys), np.concatenate(xs)
        yield pa.RecordBatch.from_arrays([*columns(y, ("sig", "doc", "line", "key")), *columns(x, ("doc", "line", "key")), pa.nulls(len(y), pa.bool_())], names=names)
    if dense:
        d = np.concatenate(dense)
        yield pa.RecordBatch.from_arrays([*columns(d, ("sig", "doc", "line", "key")), *[pa.nulls(len(d), pa.int64())] * 3, pa.array(np.concatenate(flags))], names=names)


def _rest(blobs: DataFrame, open_lines: DataFrame, parts: int, cfg: LineDedupConfig) -> DataFrame:
    """open_pairs() of every part that has open lines (sig, doc, line, key)."""
    flags = open_lines.sparkSession.sparkContext.broadcast(bucket_flags(open_lines.select(F.shiftright("sig", 16))))
    part = F.floor(F.shiftrightunsigned("sig", 32) * F.lit(parts) / F.lit(1 << 32)).cast("long")
    asked = open_lines.groupBy(part.alias("part")).agg(F.collect_list(F.struct("sig", "doc", "line", "key")).alias("asked"))
    if open_lines.count() <= OPEN_SENT:
        asked = F.broadcast(asked)
    kind = np.dtype([("sig", "<i8"), ("doc", "<i8"), ("line", "<i8"), ("key", "<i8")])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, blob in zip(b.column(0), b.column(1)):
                rows = unpacked([blob.as_py()], _SIGNED)
                rows = rows[flags.value[rows["sig"] >> 16 & (KEY_BUCKETS - 1)]]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int64()), pa.array([packed(rows)])], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, asked in zip(b.column(0), b.column(1)):
                lines = np.array([(x["sig"], x["doc"], x["line"], x["key"]) for x in asked.as_py()], kind)
                yield from open_pairs(unpacked([blob.as_py()], _SIGNED), lines, cfg)
        release()

    return blobs.mapInArrow(needed, "part long, blob binary").join(asked, "part").select("blob", "asked").mapInArrow(run, _REST)


def _verified_dense(dense: DataFrame, rows: DataFrame, cfg: LineDedupConfig) -> DataFrame:
    """The open lines (doc, line, key) of buckets (sig, doc, line, key, open) that have a similar earlier line there.

    A bucket is dealt into blocks of lines; its open lines are
    sent to each block, and a task holds a block's token sets and streams the open lines. No pair leaves a task.
    """
    place = ["doc", "line", "key"]
    size = dense.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("blocks"))
    dealt = materialise(dense.join(size, "sig"))
    sets = materialise(_line_words(rows, dealt.select(*place).distinct()))
    x = dealt.select("sig", F.pmod(F.xxhash64(*place), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), *place)
    y = dealt.filter("open").select("sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), *place)
    sent = x.unionAll(y).join(sets, place).select("sig", "block", "role", *place, "words")
    sent = sent.repartition("sig", "block").sortWithinPartitions("sig", "block", "role")
    percent = cfg.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, places, index = None, [], [], None
        for b in batches:
            out = []
            for (sig, block, role, *own), mine in _token_sets(b, 6):
                if of != (sig, block):
                    of, held, places, index = (sig, block), [], [], None
                if role == 0:
                    held.append(mine)
                    places.append(tuple(own))
                    continue
                if index is None:  # the block's sets as one sorted list of (token, line)
                    size = np.array([len(t) for t in held])
                    every, line = np.concatenate(held), np.repeat(np.arange(len(held)), size)
                    order = np.argsort(every, kind="stable")
                    index = (every[order], line[order], size)
                every, line, size = index
                lo, hi = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
                n = hi - lo
                both = np.bincount(line[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], minlength=len(held))
                similar = np.flatnonzero(100 * both >= percent * (size + len(mine) - both))
                if any(places[i] < tuple(own) for i in similar):
                    out.append(own)
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=place)

    return sent.mapInArrow(run, "doc long, line long, key long").distinct()


def _copied(first: DataFrame) -> tuple[int, int]:
    """Of sets of ``n`` lines each: how many lines they have, and the least n that at most COPIED sets exceed."""
    most = 256
    sizes, total = np.zeros(most + 1, np.int64), 0
    for r in first.groupBy(F.least("n", F.lit(most)).alias("size")).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("lines")).collect():  # 256 rows
        sizes[r["size"]], total = r["sets"], total + r["lines"]
    if sizes[most] > COPIED:
        return total, max(most, total // COPIED)
    while most > 2 and sizes[most - 1 :].sum() <= COPIED:
        most -= 1
    return total, most - 1


def removed_lines(docs: DataFrame, cfg: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """doc (doc_id, null last), rid (hash of doc_id and text) and the numbers of the lines to remove, of rows that lose any.

    Lines are what line breaks part; a token is a word with A-Z as a-z; a line's set is its distinct tokens.
    Lines are ordered by doc_id (null last) and number. A line goes if an earlier line, removed or not, has
    the same or a similar set. Lines of fewer than ``least`` tokens stay and remove nothing. Rows with the
    same doc_id and text are one document: they lose the same lines.
    """
    rows = docs.select(*_row_key(F.col("doc_id"), F.col("text")), "text").filter("text is not null")
    bits = min(DEALT_BITS, max(5, docs.rdd.getNumPartitions().bit_length()))
    marked = materialise(_occurrences(rows, bits, cfg))
    seen = marked.filter("range is null").drop("range", "counts")
    cells, least_class = token_cells(marked.filter("range is not null").select("range", "counts"), bits)
    first = seen.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line", "rid")).alias("p"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.select("k1", "k2", "p.*", "n"))
    total, least_copies = _copied(first)
    copied = first.filter(F.col("n") > least_copies).select("k1", "k2", "doc", "line").toArrow()  # at most COPIED

    parts = max(16, 12 * total // PART_ROWS)
    signed, shared = _signed(rows, cells, least_class, parts, copied, cfg)
    signed = signed.repartition(parts, "part").sortWithinPartitions("part")
    found = materialise(signed.mapInArrow(lambda it: _part_rows(it, cfg), _FOUND))
    shared.unpersist()
    place, names = ["doc", "line", "key"], ["doc", "line", "key", "xdoc", "xline", "xkey"]
    near_lines = materialise(_verified(found.filter("xdoc is not null").select(*names).distinct(), rows, cfg))

    # what these partners didn't settle, against all earlier lines of the buckets that have more
    asked = found.filter("more").select("sig", *place).join(near_lines, place, "left_anti").distinct()
    rest = materialise(_rest(found.filter("blob is not null").select("part", "blob"), materialise(asked), parts, cfg))
    few = _verified(rest.filter("xdoc is not null").select(*names).distinct(), rows, cfg)
    dense = rest.filter("xdoc is null").select("sig", *place, "open")
    gone = materialise(near_lines.unionAll(few).unionAll(_verified_dense(dense, rows, cfg)).distinct())
    discard(found, near_lines, rest)

    # sets that have a line to remove: those of several lines, and those that are gone
    first = first.withColumn("key", F.shiftright(F.shiftleft("k1", 32), 32)).withColumn("place", F.xxhash64(*place))
    maybe, stays = split_by_keys(first, "place", gone.select(F.xxhash64(*[F.col(c).cast(t) for c, t in zip(place, ("long", "int", "long"))]).alias("place")))
    maybe = maybe.join(gone.withColumn("gone", F.lit(True)), place, "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    sets = maybe.unionByName(stays.withColumn("gone", F.lit(False))).filter("gone or n > 1")
    sets = materialise(sets.selectExpr("k1", "k2", "doc as fdoc", "line as fline", "rid as frid", "gone"))
    out = split_by_keys(seen, "k1", sets.select("k1"))[0].join(sets, ["k1", "k2"])
    out = out.filter("gone or doc <> fdoc or line <> fline or rid <> frid")
    return out.groupBy("doc", "rid").agg(F.array_sort(F.collect_set(F.col("line").cast("long"))).alias("removed"))


def _row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The columns rid and doc: two rows of one doc are told apart by a hash of the text."""
    doc = doc_id.cast("long")
    return F.xxhash64(doc, text).alias("rid"), F.coalesce(doc, F.lit((1 << 63) - 1)).alias("doc")


def dedup_lines(docs: DataFrame, cfg: LineDedupConfig = LineDedupConfig(), counts: bool = False) -> DataFrame:
    """``docs`` with the removed lines taken out of the text; with ``counts``, also n_lines and n_removed.

    A row without text stays as it is and has no lines. A text whose lines all go becomes empty.
    """
    gone = materialise(removed_lines(docs, cfg))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    named = named.select("_row", *_row_key(F.col("_row.doc_id"), F.col("_row.text")))
    maybe, clear = split_by_keys(named, "rid", gone.select("rid"))
    joined = maybe.join(gone, ["rid", "doc"], "left").select("_row", "removed")
    rows = joined.unionAll(clear.select("_row", F.lit(None).cast("array<long>").alias("removed")))
    # columns of their own: an expression inside a lambda would be evaluated for every line
    out = rows.withColumn("_lines", F.when(F.col("removed").isNotNull(), F.split("_row.text", "\n", -1)))
    at = F.sequence(F.lit(0).cast("long"), F.size("_lines").cast("long") - 1)
    out = out.withColumn("_at", F.when(F.col("removed").isNotNull(), F.array_except(at, "removed")))
    kept = F.transform("_at", lambda i: F.get("_lines", i.cast("int")))
    out = out.withColumn("_text", F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n")))
    columns = [F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if not counts:
        return out.select(*columns)
    breaks = F.octet_length("_row.text") - F.octet_length(F.replace(F.col("_row.text"), F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(breaks + 1, F.lit(0)).cast("long")
    return out.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
