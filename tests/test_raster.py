"""TIFF rasters: what is written is read again, tile by tile, and files of other layouts are read."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talweg.functions.grid import GridSpec
from talweg.sources import grids, raster

SPEC = GridSpec(50, 37, 30.0, 20.0, 100.0, 50.0)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raster") / "surface.tif")
    nodes = grids.white_noise(spark, SPEC, seed=3).withColumn("z", F.when(F.col("node") % 11 != 0, F.col("z")))
    raster.write_raster(nodes.filter("node % 7 <> 0"), SPEC, path, tile=16)
    want = {r.node: r.z for r in nodes.collect()}
    return path, {n: None if n % 7 == 0 else z for n, z in want.items()}


def test_round_trip(spark, written, monkeypatch):
    path, want = written
    monkeypatch.setattr(raster, "TASK_CELLS", 16 * 16 * 2)
    nodes, spec = raster.read_raster(spark, path)
    assert spec == SPEC
    assert {r.node: r.z for r in nodes.collect()} == want
    assert nodes.count() == SPEC.size
    assert len(raster.RasterReader(nodes.schema, {"path": path}).partitions()) == 6  # 4 x 3 tiles, two each
    raster.write_raster(nodes, SPEC, path + "2", tile=16)
    assert open(path, "rb").read() == open(path + "2", "rb").read()


def test_window_and_columns(spark, written):
    path, want = written
    part, _ = raster.read_raster(spark, path, (5, 20, 18, 33), "z double, c long, node long")
    got = {r.node: (r.c, r.z) for r in part.collect()}
    assert got == {n: (n % 50, z) for n, z in want.items() if 5 <= n // 50 <= 18 and 20 <= n % 50 <= 33}
    assert part.columns == ["z", "c", "node"]
    some = raster.RasterReader(part.schema, {"path": path, "window": "5,20,18,33"}).partitions()
    assert sorted(k for p in some for k in p.numbers) == [1, 2, 5, 6]
    assert raster.read_raster(spark, path, (90, 0, 99, 5))[0].count() == 0


def strips(path, cells, order, deflated=False, predictor=1, rows=4, no_data=None):
    """A classic TIFF file of strips."""
    ny, nx = cells.shape
    cells = cells.astype(cells.dtype.newbyteorder(order))
    parts = []
    for r in range(0, ny, rows):
        part = cells[r : r + rows]
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=cells.dtype.type(0)).astype(cells.dtype)
        parts.append(zlib.compress(part.tobytes()) if deflated else part.tobytes())
    offsets = [8 + sum(map(len, parts[:i])) for i in range(len(parts))]
    tags = [(256, 3, [nx]), (257, 3, [ny]), (258, 3, [cells.dtype.itemsize * 8]), (259, 3, [8 if deflated else 1]), (273, 4, offsets), (277, 3, [1]), (278, 3, [rows]), (279, 4, [len(p) for p in parts]),
            (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[cells.dtype.kind]])]
    if no_data is not None:
        tags.append((42113, 2, [bytes([b]) for b in no_data]))
    place = 8 + sum(map(len, parts))
    ifd, more = b"", b""
    for tag, field, values in tags:
        body = struct.pack(order + raster.FIELDS[field][1] * len(values), *values)
        here = body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", place + 2 + 12 * len(tags) + 4 + len(more))
        more += b"" if len(body) <= 4 else body
        ifd += struct.pack(order + "HHI", tag, field, len(values)) + here
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, place)
    open(path, "wb").write(head + b"".join(parts) + struct.pack(order + "H", len(tags)) + ifd + bytes(4) + more)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("dtype, deflated, predictor", [("f4", False, 1), ("f8", True, 1), ("i2", True, 2), ("u1", False, 2), ("u4", False, 1)])
def test_other_layouts(spark, tmp_path, order, dtype, deflated, predictor):
    cells = np.random.default_rng(1).integers(0, 200, (10, 7)).astype(dtype)
    cells[3, 4] = 99
    path = str(tmp_path / "a.tif")
    strips(path, cells, order, deflated, predictor, no_data=b"99\0")
    nodes, spec = raster.read_raster(spark, path)
    assert (spec.nx, spec.ny, spec.xmin, spec.ymin) == (7, 10, 0.0, 0.0)
    got = {r.node: r.z for r in nodes.collect()}
    assert got == {i: None if v == 99 else float(v) for i, v in enumerate(cells.ravel().tolist())}


def test_refused(tmp_path):
    (tmp_path / "a").write_bytes(b"II\x2b\x01" + bytes(40))
    with pytest.raises(ValueError):
        raster.Header(str(tmp_path / "a"))
    with pytest.raises(ValueError):
        raster.RasterReader(StructType().add("other", "long"), {"path": "x"})


def test_first_cells_of_tiles_in_any_order_of_rows(spark, tmp_path, monkeypatch):
    spec = GridSpec(40, 33)
    nodes = spark.range(spec.size).select(F.col("id").alias("node"), (F.col("id") + 0.5).alias("z"))
    kind = type(nodes)
    union = kind.unionAll
    monkeypatch.setattr(kind, "unionAll", lambda a, b: union(b, a))  # over several executors rows arrive as they come
    raster.write_raster(nodes, spec, str(tmp_path / "a.tif"), tile=16)
    got = {r.node: r.z for r in raster.read_raster(spark, str(tmp_path / "a.tif"))[0].collect()}
    assert got == {i: i + 0.5 for i in range(spec.size)}
