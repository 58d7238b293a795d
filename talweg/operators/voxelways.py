"""Shortest ways through voxels by blocks that are one bit for each place: edges are never listed.

A block knows which places of its own and of the rim around it are taken. A round solves the blocks that were told better
values of their rims, in order of values, and they tell others those of their own rims. The way is then followed back from
block to block, each solved once more. So a voxel is shuffled once, as four bytes, and rounds grow with the blocks crossed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .parts import SLACK
from .voxels import XYZ, ring

#: Places of a block with six neighbours each; fewer with more neighbours.
PLACES = 1 << 19
#: Rows of a way that the driver holds before they are written.
HELD = 1 << 20

Place = tuple[int, int, int]


@dataclass(frozen=True)
class Blocks:
    """A box of places (from ``low``, ``size`` along each axis) in blocks of ``side``. A place in a block has a number
    among its own and those of the rim around them, in the order of x, y, z."""

    low: Place
    size: Place
    side: Place
    connectivity: int

    @staticmethod
    def over(low: Place, size: Place, connectivity: int, side: int | None = None) -> Blocks:
        if side:
            return Blocks(low, size, (side,) * 3, connectivity)
        left, sides = PLACES * 6 // connectivity, {}
        for n, k in enumerate(sorted(range(3), key=lambda k: size[k])):  # a flat box has wide blocks
            sides[k] = max(1, min(size[k], int(left ** (1 / (3 - n)) + 1e-6)))
            left //= sides[k]
        return Blocks(low, size, (sides[0], sides[1], sides[2]), connectivity)

    @cached_property
    def counts(self) -> Place:
        return tuple(-(-n // s) for n, s in zip(self.size, self.side))

    @cached_property
    def wide(self) -> Place:
        return tuple(s + 2 for s in self.side)

    @cached_property
    def moves(self) -> list[tuple[int, float]]:
        """How far the neighbours' numbers are, and their distances."""
        return [((a * self.wide[1] + b) * self.wide[2] + c, float(abs(a) + abs(b) + abs(c)) ** 0.5) for a, b, c in ring(self.connectivity)]

    @cached_property
    def inner(self) -> np.ndarray:
        own = np.zeros(self.wide, bool)
        own[1:-1, 1:-1, 1:-1] = True
        return own.ravel()

    def number(self, at: list) -> np.ndarray | int:
        """The number of a place from its position in the block."""
        x, y, z = at
        return ((x + 1) * self.wide[1] + y + 1) * self.wide[2] + z + 1

    def part(self, at: list) -> np.ndarray | int:
        x, y, z = at
        return (x * self.counts[1] + y) * self.counts[2] + z

    def corner(self, part: int) -> list[int]:
        """The first place of a block, from the box's."""
        x, yz = divmod(part, self.counts[1] * self.counts[2])
        return [v * s for v, s in zip((x, *divmod(yz, self.counts[2])), self.side)]

    def positions(self, part: int, cells: np.ndarray) -> list[np.ndarray]:
        """The places of numbers in a block."""
        return [v - 1 + c + lo for v, c, lo in zip(np.unravel_index(cells, self.wide), self.corner(part), self.low)]

    def seen(self, places: list[np.ndarray], rim_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Which places, their blocks and their numbers there: in the own one and in those whose rim they are on."""
        block = [(v - lo) // s for v, lo, s in zip(places, self.low, self.side)]
        at = [v - lo - b * s for v, lo, b, s in zip(places, self.low, block, self.side)]
        for d in product((-1, 0, 1), repeat=3):
            if rim_only and not any(d) or any(d) and d not in ring(self.connectivity):
                continue
            use = np.ones(len(at[0]), bool)
            for k in range(3):
                if d[k]:
                    use &= (at[k] == (self.side[k] - 1 if d[k] > 0 else 0)) & (block[k] + d[k] >= 0) & (block[k] + d[k] < self.counts[k])
            use = np.flatnonzero(use)
            if len(use):
                yield use, self.part([b[use] + e for b, e in zip(block, d)]), self.number([a[use] - e * s for a, e, s in zip(at, d, self.side)])

    def place(self, p: Place) -> tuple[int, int]:
        """A place's block and its number there."""
        block = [(v - lo) // s for v, lo, s in zip(p, self.low, self.side)]
        return self.part(block), self.number([v - lo - b * s for v, lo, b, s in zip(p, self.low, block, self.side)])


def _deal(geo: Blocks) -> Callable:
    """Places as numbers in the blocks that see them, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, cells = [], []
            for _, part, cell in geo.seen([b.column(k).to_numpy() for k in range(3)]):
                order = np.argsort(part, kind="stable")
                part, cell = part[order], cell[order].astype(np.int32)
                at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                parts += part[at].tolist()
                cells += [x.tobytes() for x in np.split(cell, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(cells, pa.binary())], names=["part", "cells"])

    return run


def _bits(geo: Blocks) -> Callable:
    """part, bits: the places of ``with`` (numbers) and of the bits so far, without those of ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                taken, value = _open(b["bits"][i].as_py(), geo), b.schema.names[-1] == "with"
                for x in b.column(2)[i].as_py() or []:
                    taken[np.frombuffer(x, np.int32)] = value
                out.append(np.packbits(taken).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["part", "bits"])

    return run


def _open(bits: bytes | None, geo: Blocks) -> np.ndarray:
    n = len(geo.inner)
    return np.zeros(n, bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def pack(places: DataFrame, geo: Blocks) -> DataFrame:
    """part, bits of the blocks that see any of the places (x, y, z), written."""
    rows = places.select(*XYZ).mapInArrow(_deal(geo), "part long, cells binary")
    rows = rows.groupBy("part").agg(F.collect_list("cells").alias("with")).select("part", F.lit(None).cast("binary").alias("bits"), "with")
    return cut(rows.mapInArrow(_bits(geo), "part long, bits binary"))


def without(blocks: DataFrame, places: DataFrame, geo: Blocks) -> DataFrame:
    """The blocks without some places."""
    gone = places.select(*XYZ).mapInArrow(_deal(geo), "part long, cells binary").groupBy("part").agg(F.collect_list("cells").alias("gone"))
    return cut(blocks.join(gone, "part", "left").select("part", "bits", "gone").mapInArrow(_bits(geo), "part long, bits binary"))


def _settle(taken: np.ndarray, cells: np.ndarray, got: np.ndarray, geo: Blocks) -> np.ndarray:
    """The least values of a block's places, from given ones. As steps are 1 at least, those less than 1 above the least one
    that hasn't gone on are final, so each place goes on once."""
    value = np.full(len(taken), np.inf)
    np.minimum.at(value, cells, got)
    own = taken & geo.inner
    waiting = np.unique(cells[np.isfinite(got)])
    queued = np.zeros(len(taken), bool)
    queued[waiting] = True
    while len(waiting):
        v = value[waiting]
        now = v < v.min() + 1
        front, waiting = waiting[now], [waiting[~now]]
        queued[front] = False
        mine = value[front]
        for far, w in geo.moves:
            to = front + far
            inside = (to >= 0) & (to < len(own))  # places of the rim have neighbours beyond it
            to, v = to[inside], mine[inside] + w
            better = own[to] & (v < value[to])
            to = to[better]
            value[to] = v[better]
            to = to[~queued[to]]
            queued[to] = True
            waiting.append(to)
        waiting = np.concatenate(waiting)
    return value


def _solved(batches: Iterator[pa.RecordBatch], geo: Blocks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            taken, mail = _open(b["bits"][i].as_py(), geo), b["mail"][i].values
            cells, got = (mail.field(n).to_numpy() for n in ("cell", "value"))
            here = taken[cells]
            yield b["part"][i].as_py(), taken, _settle(taken, cells[here], got[here], geo)


def _tell(geo: Blocks, goal: Place, upper: float) -> Callable:
    """What solved blocks tell others of their rims, without what is beyond the bound; the goal's value goes to block -1."""
    goal_part, goal_cell = geo.place(goal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, value in _solved(batches, geo):
            cells = np.flatnonzero(np.isfinite(value) & geo.inner)
            places = geo.positions(part, cells)
            gaps = [np.abs(v - g) for v, g in zip(places, goal)]
            low = sum(gaps) if geo.connectivity == 6 else np.sqrt(sum(g * g for g in gaps))
            good = np.flatnonzero(value[cells] + low <= upper * (1 + SLACK))
            parts, at, got = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for use, to, cell in geo.seen([v[good] for v in places], rim_only=True):
                parts.append(to)
                at.append(cell)
                got.append(value[cells[good[use]]])
            if part == goal_part and np.isfinite(value[goal_cell]):
                parts.append(np.array([-1]))
                at.append(np.array([goal_cell]))
                got.append(value[[goal_cell]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (parts, at, got)], names=["part", "cell", "value"])

    return run


def _back(geo: Blocks, start: Place, at: int) -> Callable:
    """The way back from a place of a block to the start, or to the first place of another block, which comes last with the
    mark ``on``. Of several places before one it takes the one of least value, then of least number."""
    start_part, start_cell = geo.place(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, value in _solved(batches, geo):
            way = [at]
            while geo.inner[way[-1]] and not (part == start_part and way[-1] == start_cell):
                d = value[way[-1]]
                near = [(value[n], n) for far, w in geo.moves if value[n := way[-1] + far] < d and abs(value[n] + w - d) <= SLACK * (1 + abs(d))]
                way.append(int(min(near)[1]))
            cells = np.array(way)
            on = not geo.inner[way[-1]]
            yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in geo.positions(part, cells)], pa.array(value[cells]), pa.array([on and k == len(way) - 1 for k in range(len(way))])], names=[*XYZ, "value", "on"])

    return run


def way(blocks: DataFrame, geo: Blocks, start: Place, goal: Place) -> DataFrame:
    """step, x, y, z, value of the shortest way between two different places of the blocks; empty without a way."""
    spark, names = blocks.sparkSession, "step long, x long, y long, z long, value double"
    front = geo.counts[0] * geo.counts[1] * geo.counts[2] // max(geo.counts)  # blocks that a round solves, about
    part, cell = geo.place(start)
    inbox = fresh = spark.createDataFrame([(part, cell, 0.0)], "part long, cell long, value double")
    upper, key = float("inf"), ["part", "cell"]

    def with_mail(mail: DataFrame, tasks: int = min(128, 2 * front)) -> DataFrame:
        mail = mail.groupBy("part").agg(F.collect_list(F.struct("cell", "value")).alias("mail"))  # a block's rim at most
        return blocks.join(mail, "part").repartition(tasks, "part")  # else few tasks, as there are few bytes

    while True:
        mail = inbox.join(fresh.select("part").distinct(), "part", "left_semi")
        sent = with_mail(mail).mapInArrow(_tell(geo, goal, upper), "part long, cell long, value double")
        sent = sent.groupBy(*key).agg(F.min("value").alias("got"))
        both = inbox.join(sent, key, "full").withColumn("better", F.col("got").isNotNull() & (F.col("value").isNull() | (F.col("got") < F.col("value"))))
        both = cut(both.select(*key, F.least("value", "got").alias("value"), "better"))
        fresh, inbox = both.filter("better and part >= 0").drop("better"), both.drop("better")
        reached, more = both.agg(F.min(F.when(F.col("part") == -1, F.col("value"))), F.coalesce(F.max(F.col("better") & (F.col("part") >= 0)), F.lit(False))).first()
        upper = upper if reached is None else min(upper, reached)
        if not more:
            break
    if upper == float("inf"):
        return spark.createDataFrame([], names)
    out, rows, length, at = None, [], 0, goal

    def written(rows: list, out: DataFrame | None) -> DataFrame:
        some = cut(spark.createDataFrame(rows, "back long, x long, y long, z long, value double"))
        return some if out is None else out.unionAll(some)

    while at is not None:
        part, cell = geo.place(at)
        got = with_mail(inbox.filter(F.col("part") == part), 1).mapInArrow(_back(geo, start, cell), "x long, y long, z long, value double, on boolean").collect()
        at = (got[-1].x, got[-1].y, got[-1].z) if got[-1].on else None
        for r in got[: len(got) - (at is not None)]:
            rows.append((length, r.x, r.y, r.z, r.value))
            length += 1
        if len(rows) >= HELD:
            out, rows = written(rows, out), []
    out = written(rows, out) if rows else out
    return out.select((F.lit(length - 1) - F.col("back")).alias("step"), *XYZ, "value")


def found_in(vox: DataFrame, start: Place, goal: Place, connectivity: int, side: int | None = None) -> tuple[DataFrame, Blocks] | None:
    """The blocks of some voxels, and how they lie; none if start or goal isn't among them."""
    places = vox.select(*[F.col(k).cast("long").alias(k) for k in XYZ]).dropna()
    ends = [F.max((F.col("x") == p[0]) & (F.col("y") == p[1]) & (F.col("z") == p[2])) for p in (start, goal)]
    row = places.agg(*[f(k) for k in XYZ for f in (F.min, F.max)], *ends).first()
    if not (row[6] and row[7]):
        return None
    low = tuple(row[2 * k] for k in range(3))
    geo = Blocks.over(low, tuple(row[2 * k + 1] - row[2 * k] + 1 for k in range(3)), connectivity, side)
    return pack(places, geo), geo
