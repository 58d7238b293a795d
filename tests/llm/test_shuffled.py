"""How much line dedup shuffles, and that nothing is lost by it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from talweg.llm import linededup


def test_a_signature_takes_few_bytes(spark):
    rng = np.random.default_rng(5)
    texts = ["\n".join(" ".join(f"w{k}" for k in rng.integers(0, 1 << 40, 30)) for _ in range(6)) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc long, text string").coalesce(1)
    none = pa.table({c: pa.array([], pa.int64()) for c in ("k1", "k2", "doc", "line")})
    cells = np.full(1 << linededup.CELL_BITS, 2, np.uint8)
    signed, shared = linededup._signed(rows, cells, 2, 4, none, linededup.LineDedupConfig())
    blobs = [bytes(r["blob"]) for r in signed.collect()]
    shared.unpersist()
    n = len(linededup.unpacked(blobs, linededup._SIGNED))
    assert n == 7 * 6 * 300  # the prefix of each line
    assert sum(map(len, blobs)) < 25 * n


def test_copies_are_told_as_far_as_the_table_reaches(spark, monkeypatch):
    sets = spark.createDataFrame([(n,) for n in [1] * 5 + [2] * 4 + [3] * 3 + [7] * 2 + [1000]], "n long")
    for most, least in ((100, 1), (10, 1), (9, 2), (6, 2), (5, 3), (3, 3), (2, 7), (1, 7)):
        monkeypatch.setattr(linededup, "COPIED", most)
        total, found = linededup._copied(sets)
        assert total == 1036 and found == least
        assert sets.filter(sets.n > found).count() <= most
    monkeypatch.setattr(linededup, "COPIED", 2)
    many = spark.createDataFrame([(n,) for n in [300] * 3 + [900]], "n long")
    assert linededup._copied(many) == (1800, 900)
