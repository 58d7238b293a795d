"""Signatures of lines: similar lines share one, and their number grows with a line's length only."""

from __future__ import annotations

import random

import numpy as np

from talweg.llm.linededup import LineDedupConfig, line_signatures
from talweg.llm.text import U64, mix


def _signed(tokens: list[int], kinds: np.ndarray, hot: int, rare: bool) -> list[int]:
    h, kind = mix(np.array(tokens, np.uint64) + U64(7)), kinds[tokens]
    order = np.lexsort((h, kind))
    one = np.array([0]), np.array([len(tokens)])
    return line_signatures(h[order], kind[order], *one, hot, rare, LineDedupConfig())[1].tolist()


def test_frequent_tokens_do_not_square_the_signatures():
    kinds = np.full(400, 200, np.uint8)
    for n in (16, 40, 100, 300):
        found = _signed(list(range(n)), kinds, 88, True)
        assert len(found) == len(set(found)) <= 0.4 * n + 2  # 21 * 22 / 2 for 100 tokens, each with each


def test_similar_lines_share_a_signature():
    rng = random.Random(4)
    for _ in range(4000):
        n, hot, rare = rng.randrange(5, 90), rng.choice([0, 20, 60, 255]), rng.random() < 0.5
        lost = rng.randrange(n // 5 + 1)
        most = max(0, 100 * (n - lost) // 80 - n)
        added = rng.choice([most, rng.randrange(most + 1)])
        every = rng.sample(range(300), n + added)
        x, y = every[:n], every[lost:]
        kinds = np.array([rng.randrange(1, 256) for _ in range(300)], np.uint8)
        for t in every[:lost] + every[n:]:  # tokens of one line only
            kinds[t] *= rng.random() < 0.7
        assert set(_signed(x, kinds, hot, rare)) & set(_signed(y, kinds, hot, rare)), (n, lost, added, hot, rare)
