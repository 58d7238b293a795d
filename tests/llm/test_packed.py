"""Rows as line dedup shuffles them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from talweg.llm import linededup
from talweg.llm.linededup import _COUNT, _SIGNED, packed, unpacked


def test_signatures_take_less_room_and_come_back():
    rng = np.random.default_rng(1)
    rows = np.zeros(5000, _SIGNED)
    for name in ("sig", "low", "high"):
        rows[name] = rng.integers(-(1 << 63), 1 << 63, len(rows))
    rows["key"] = rng.integers(-(1 << 31), 1 << 31, len(rows))
    rows["doc"], rows["line"] = 7_000_000 + np.arange(len(rows)) // 50, np.arange(len(rows)) % 50
    rows["n"], rows["pos"] = rng.integers(5, 60, len(rows)), rng.integers(0, 12, len(rows))
    rows["doc"][-1], rows["n"][-1] = np.iinfo(np.int64).max, 65535
    assert len(packed(rows)) < 0.85 * len(pa.compress(rows.tobytes(), "lz4", asbytes=True))
    back = unpacked([packed(rows[:1234]), packed(rows[:0]), packed(rows[1234:])], _SIGNED)
    assert back.dtype == rows.dtype and (back == rows).all()
    back["n"][0] = 3  # the rows can be written to
    assert not len(unpacked([], _SIGNED)) and not len(unpacked([packed(np.empty(0, _COUNT))], _COUNT))


def test_short_lines_take_less_room_when_dealt(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30)), "en") for i in range(300)], "doc long, text string, lang string")
    none = pa.table({c: pa.array([], pa.int64()) for c in ("k1", "k2", "doc", "line")})
    cells = np.full(1 << linededup.CELL_BITS, 2, np.uint8)
    signed, shared = linededup._signed(rows, cells, 2, 1, none, linededup.LineDedupConfig())
    blobs = [r["blob"] for r in signed.collect()]
    shared.unpersist()
    assert (unpacked([bytes(b) for b in blobs], _SIGNED)["high"] == 0).all()
    assert sum(map(len, blobs)) < 22 * 300 * 7  # bytes of 7 signatures a line; 26 and more with the whole bitmap


def test_bitmaps_of_short_and_long_lines_never_refuse_similar_ones():
    rng = np.random.default_rng(3)
    for n in (50, 60, 64, 65, 70, 80):
        tokens = rng.integers(0, 1 << 63, (40, 2 * n), dtype=np.uint64)
        pairs = [(t[: n + n // 5], t[n // 5 : n + n // 5]) if n % 2 else (t[:n], t[n // 10 : n + n // 20]) for t in tokens]
        for x, y in pairs:
            marks = [[np.array([len(z)]), *(s.view(np.uint64) for s in linededup.sketches(z, np.zeros(len(z), int), 1)), np.array([0])] for z in (x, y)]
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert len(linededup.plausible(*marks, 80)[0]) == 1
