"""Repeated strings against a plain version: a dictionary of all strings of a length."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from talweg.llm import repeats
from talweg.llm.common import table

from .cases import edge_docs, edge_rows

SMALL = repeats.RepeatConfig(length=60, window=4, reach=6)


def plain(texts, size):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        edges = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), edges, hashlib.sha256(left).hexdigest(), left))
    return out


def check(spark, rows, cfg):
    df = spark.createDataFrame(rows, "doc_id long, text string, u long, i long")
    got = sorted((tuple(r) for r in repeats.without_repeats(df, cfg, texts=True).collect()), key=str)
    want = plain([t for _, t, *_ in rows], cfg.length)
    assert got == sorted(((i, n, g, s, h, bytearray(left)) for (i, *_), (n, g, s, h, left) in zip(rows, want)), key=str)
    return sum(r[2] for r in got)


def mixed(seed, n, size):
    """Texts that share passages of about ``size`` bytes, longer and shorter, with other text around them."""
    rng = random.Random(seed)
    some = lambda k, of="abcdefgh é": "".join(rng.choice(of) for _ in range(k))
    passages = [some(rng.randrange(size - 10, 3 * size)) for _ in range(12)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append(some(rng.randrange(0, 2 * size)))
            p = rng.choice(passages)
            if rng.random() < 0.4:  # a copy with a change or a part of it
                k = rng.randrange(len(p))
                p = p[:k] + some(1) + p[k + 1 :] if rng.random() < 0.5 else p[k:]
            parts.append(p)
        rows.append((d % 50, "".join(parts), 0, 0))
    rows += [(1000, "a" * 4 * size, 1, 1), (1001, "ab" * size, 1, 1), (1002, "a" * (size - 1), 1, 1), (1003, None, 1, 1), (1004, "", 1, 1), (1005, "xyz" * size + some(30), 1, 1)]
    return [*rows, rows[0], rows[0], rows[3]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_of_all_lengths(spark, seed):
    assert check(spark, mixed(seed, 60, SMALL.length), SMALL) > 1000


def test_other_triggers_give_the_same(spark):
    rows = mixed(5, 40, 60)
    for window, reach, group in ((1, 3, 256), (8, 20, 3), (16, 12, 1)):
        check(spark, rows, repeats.RepeatConfig(length=60, window=window, reach=reach, group=group))


def test_large_length(spark):
    assert check(spark, mixed(4, 30, 400), repeats.RepeatConfig()) > 3000


def test_edge_rows(spark):
    got = repeats.without_repeats(edge_docs(spark)).collect()
    want = plain([r[1] for r in edge_rows()], 400)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(e[0]), *w[:4]) for e, w in zip(edge_rows(), want))
    assert repeats.without_repeats(edge_docs(spark).limit(0)).collect() == []


def test_documents(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert check(spark, [(r.doc_id, r.text, 0, 0) for r in rows], repeats.RepeatConfig()) > 0
