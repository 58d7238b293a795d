"""TIFF rasters by tiles: a data source with a partition for each run of tiles, and a writer of which each task fills its
own tiles. No task and not the driver ever holds a raster; the driver reads its header only.

Files lie on a path that the driver and all executors have mounted.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.grid import GridSpec

#: Fixed values of the format: field types with their sizes and struct codes, and tags.
FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, NO_DATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113

TASK_CELLS = 1 << 22
SCHEMA = "node long, r long, c long, z double"


class Header:
    """What a TIFF file, classic or big, says of its first image. Arrays of places stay in the file until asked for."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            start = f.read(16)
            if start[:2] not in (b"II", b"MM"):
                raise ValueError(f"{path} is no TIFF file")
            self.order = "<" if start[:2] == b"II" else ">"
            kind = struct.unpack(self.order + "H", start[2:4])[0]
            if kind not in (42, 43):
                raise ValueError(f"{path} is no TIFF file")
            self.big = kind == 43
            f.seek(struct.unpack(self.order + ("Q" if self.big else "I"), start[8:16] if self.big else start[4:8])[0])
            n = struct.unpack(self.order + ("Q" if self.big else "H"), f.read(8 if self.big else 2))[0]
            size, form = (20, "HHQ") if self.big else (12, "HHI")
            at, raw = f.tell(), f.read(n * size)
            self.tags: dict[int, tuple[int, int, int]] = {}
            room = 8 if self.big else 4
            for i in range(n):
                entry = raw[i * size : (i + 1) * size]
                tag, field, count = struct.unpack(self.order + form, entry[: size - room])
                if field not in FIELDS:
                    continue
                place = at + (i + 1) * size - room
                if FIELDS[field][0] * count > room:
                    place = struct.unpack(self.order + ("Q" if self.big else "I"), entry[size - room :])[0]
                self.tags[tag] = (field, count, place)
            one = {t: self.values(f, t)[0] for t in (WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, STRIP_ROWS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, FORMAT) if t in self.tags}
            self.nx, self.ny = one[WIDTH], one[HEIGHT]
            self.compression, self.predictor = one.get(COMPRESSION, 1), one.get(PREDICTOR, 1)
            kind = {1: "u", 2: "i", 3: "f"}.get(one.get(FORMAT, 1))
            bits = one.get(BITS, 1)
            if one.get(SAMPLES, 1) != 1 or kind is None or bits not in (8, 16, 32, 64) or self.compression not in (1, 8, 32946) or self.predictor not in (1, 2) or (kind == "f" and (bits < 16 or self.predictor == 2)):
                raise ValueError(f"{path}: one band of whole or real numbers, plain or deflated, is read; this has others")
            self.dtype = np.dtype(f"{self.order}{kind}{bits // 8}")
            self.tiled = TILE_WIDTH in one
            self.tx = one[TILE_WIDTH] if self.tiled else self.nx
            self.ty = one[TILE_HEIGHT] if self.tiled else min(one.get(STRIP_ROWS, self.ny), self.ny)
            self.across, self.down = -(-self.nx // self.tx), -(-self.ny // self.ty)
            scale = self.values(f, SCALE) if SCALE in self.tags else (1.0, 1.0)
            tie = self.values(f, TIEPOINT) if TIEPOINT in self.tags else (0.0, 0.0, 0.0, 0.0, self.ny * scale[1], 0.0)
            x, top = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
            self.spec = GridSpec(self.nx, self.ny, scale[0], scale[1], x, top - self.ny * scale[1])
            self.no_data = None
            if NO_DATA in self.tags:
                self.no_data = float(b"".join(self.values(f, NO_DATA)).split(b"\0")[0])

    def values(self, f, tag: int, first: int = 0, count: int | None = None) -> tuple:
        """Values of a tag, ``count`` of them from ``first`` on (all by default)."""
        field, total, place = self.tags[tag]
        size, code = FIELDS[field]
        n = total - first if count is None else count
        f.seek(place + first * size)
        return struct.unpack(self.order + code * n, f.read(size * n))

    def tile(self, f, k: int) -> np.ndarray:
        """The cells of one tile that lie in the raster."""
        r0, c0 = k // self.across * self.ty, k % self.across * self.tx
        rows = self.ty if self.tiled else min(self.ty, self.ny - r0)
        offset = self.values(f, TILES if self.tiled else STRIPS, k, 1)[0]
        length = self.values(f, TILE_SIZES if self.tiled else STRIP_SIZES, k, 1)[0]
        f.seek(offset)
        raw = f.read(length)
        if self.compression != 1:
            raw = zlib.decompress(raw)
        out = np.frombuffer(raw, self.dtype, rows * self.tx).reshape(rows, self.tx)
        if self.predictor == 2:
            out = np.cumsum(out, axis=1, dtype=self.dtype.newbyteorder("="))
        return out[: self.ny - r0, : self.nx - c0]


@dataclass
class Tiles(InputPartition):
    """Tiles of a file."""

    path: str
    numbers: list[int]


class RasterReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = [f.name for f in schema.fields]
        if not set(self.columns) <= {"node", "r", "c", "z"}:
            raise ValueError(f"columns are among {SCHEMA}")
        self.path = options["path"]
        window = options.get("window")
        self.window = [int(v) for v in window.split(",")] if window else None

    def _box(self, h: Header) -> tuple[int, int, int, int]:
        r0, c0, r1, c1 = self.window or (0, 0, h.ny - 1, h.nx - 1)
        return max(r0, 0), max(c0, 0), min(r1, h.ny - 1), min(c1, h.nx - 1)

    def partitions(self) -> list[Tiles]:
        h = Header(self.path)
        r0, c0, r1, c1 = self._box(h)
        wanted = [r * h.across + c for r in range(r0 // h.ty, r1 // h.ty + 1) for c in range(c0 // h.tx, c1 // h.tx + 1)] if r0 <= r1 and c0 <= c1 else []
        each = max(1, TASK_CELLS // (h.tx * h.ty))
        return [Tiles(self.path, wanted[i : i + each]) for i in range(0, len(wanted), each)] or [Tiles(self.path, [])]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        h = Header(partition.path)
        r0, c0, r1, c1 = self._box(h)
        with open(partition.path, "rb") as f:
            for k in partition.numbers:
                top, left = k // h.across * h.ty, k % h.across * h.tx
                a, b = max(r0 - top, 0), max(c0 - left, 0)
                z = h.tile(f, k)[a : r1 - top + 1, b : c1 - left + 1]
                r = np.repeat(np.arange(top + a, top + a + z.shape[0]), z.shape[1])
                c = np.tile(np.arange(left + b, left + b + z.shape[1]), z.shape[0])
                made = {"r": lambda: pa.array(r), "c": lambda: pa.array(c), "node": lambda: pa.array(r * h.nx + c), "z": lambda: self._z(h, z)}
                yield pa.RecordBatch.from_arrays([made[n]() for n in self.columns], names=self.columns)

    @staticmethod
    def _z(h: Header, z: np.ndarray) -> pa.Array:
        flat = z.ravel().astype(np.float64)
        missing = np.isnan(flat) if h.no_data is None else np.isnan(flat) | (flat == h.no_data)
        return pa.array(flat, mask=missing)


class RasterSource(DataSource):
    """Format ``raster``: node, r, c and z (null where there are no data) of a TIFF file with one band.

    A schema given by the reader picks columns, the others aren't made; the option ``window`` (first row, first column,
    last row, last column) picks tiles, the others aren't read. A partition is as many tiles as have TASK_CELLS cells.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(schema, self.options)


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, columns: str = "node long, z double") -> tuple[DataFrame, GridSpec]:
    """nodes and grid of a TIFF file; nodes are those of the whole raster, also with a window."""
    spark.dataSource.register(RasterSource)
    read = spark.read.format("raster").schema(columns)
    if window is not None:
        read = read.option("window", ",".join(map(str, window)))
    return read.load(path), Header(path).spec


def write_raster(nodes: DataFrame, spec: GridSpec, path: str, column: str = "z", tile: int = 256, no_data: float = -9999.0) -> None:
    """Write a column as a big TIFF file of plain tiles. A tile's place follows from its number: the driver writes the
    header and sets the length, each task fills its own tiles, and one that is repeated writes the same bytes again.

    Nodes that are missing or null have no data; of several rows for a node one is written. ``tile`` is a multiple of 16.
    """
    across, down = -(-spec.nx // tile), -(-spec.ny // tile)
    count, size = across * down, tile * tile * 8
    mark = f"{no_data:g}".encode() + b"\0"
    tags = [(WIDTH, 4, [spec.nx]), (HEIGHT, 4, [spec.ny]), (BITS, 3, [64]), (COMPRESSION, 3, [1]), (262, 3, [1]), (SAMPLES, 3, [1]), (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]),
            (TILES, 16, None), (TILE_SIZES, 16, None), (FORMAT, 3, [3]), (SCALE, 12, [spec.dx, spec.dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, spec.xmin, spec.ymin + spec.ny * spec.dy, 0.0]), (NO_DATA, 2, mark)]
    after = 16 + 8 + 20 * len(tags) + 8
    extra = [0 if v is None else len(v) * FIELDS[t][0] for _, t, v in tags]
    start = -(-(after + sum(e for e in extra if e > 8) + 2 * 8 * count) // 4096) * 4096
    entries, more = b"", b""
    for (tag, field, values), length in zip(tags, extra):
        n = count if values is None else len(values)
        if values is None:
            body = (np.arange(count) * size + start if tag == TILES else np.full(count, size)).astype("<u8").tobytes()
        else:
            body = values if field == 2 else struct.pack("<" + FIELDS[field][1] * n, *values)
        here = body.ljust(8, b"\0") if len(body) <= 8 else struct.pack("<Q", after + len(more))
        more += b"" if len(body) <= 8 else body
        entries += struct.pack("<HHQ", tag, field, n) + here
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0) + more)
        f.truncate(start + count * size)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["k"].iloc[0])
        rows = rows[rows["v"].notna()]  # rows come in any order: that of the empty tile must not undo a value
        cells = np.full(tile * tile, no_data, "<f8")
        cells[rows["at"].to_numpy(np.int64)] = rows["v"].to_numpy()
        with open(path, "r+b") as f:
            f.seek(start + k * size)
            f.write(cells.tobytes())
        return pd.DataFrame({"k": [k]})

    rc = spec.with_rowcol(nodes.select("node", F.col(column).cast("double").alias("v")))
    k = (F.floor(F.col("r") / tile) * across + F.floor(F.col("c") / tile)).cast("long")
    at = (F.col("r") % tile * tile + F.col("c") % tile).cast("long")
    empty = nodes.sparkSession.range(count).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("double").alias("v"))
    cells = empty.unionAll(rc.select(k.alias("k"), at.alias("at"), "v"))  # a tile without nodes is filled too
    cells.groupBy("k").applyInPandas(fill, "k long").agg(F.count(F.lit(1))).collect()
