"""Vectorised word splitting and hashing over byte buffers (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = U64(1)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and the end of each word of UTF-8 text."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of spans (A-Z as a-z); equal bytes have equal hashes wherever they are."""
    if not len(start):
        return np.empty(0, U64)
    b = np.frombuffer(raw, np.uint8)
    power, inverse = _power(len(b))
    total = np.zeros(len(b) + 1, U64)
    np.cumsum(_BYTE[b] * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[np.minimum(start, len(b) - 1)] + (end - start).astype(U64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 text (A-Z as a-z), with each word's first byte and end."""
    if not raw:
        none = np.empty(0, np.int64)
        return np.empty(0, U64), none, none
    start, end = words_of(raw)
    return span_hashes(raw, start, end), start, end


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles in order of hash; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, U64)
    for i in range(k):
        h = mix(h * U64(3) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def chunks(rows: list, size, limit: int) -> Iterator[list]:
    """Runs of rows whose sizes sum to at most ``limit`` (a larger row comes alone)."""
    run, total = [], 0
    for row in rows:
        n = size(row)
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(row)
        total += n
    if run:
        yield run
