"""Rows that every operator has to bear, and plain versions of the rules that the operators are held against."""

from __future__ import annotations

import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, score string, ids string, _row int, id string"


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    long_text = "\n".join(" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30)) for _ in range(300))
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (None, "a text without an id here now"), (5, long_text),
        (6, "x" * 20_000), (7, "dup words of a row that is here twice"), (7, "dup words of a row that is here twice"),
        (8, "café \U0001f389 naïve 日本語 text"), (9, "\n\n\n"), (10, "mail bob@example.com or 10.0.0.1 call +1 (555) 555-0100 card 4111 1111 1111 1111"),
        (11, "dup words of a row that is here twice"), (-5, "negative id and words"), (1 << 62, "a very large id and words"),
    ]
    return [(i, t, None if i == 4 else "en", None if i in (2, 4) else f"s{(i or 0) % 3}", len(t or ""), "9", 3, "z", "q", 1, "k") for i, t in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text: str | None, k: int) -> set:
    w = words(lower(text or ""))
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_components(rows: list[tuple[int, str | None]], k: int) -> dict[int, int]:
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def removed_lines(rows: list[tuple[int, str | None]], percent: int = 80, least: int = 1) -> dict[int, set[int]]:
    first: dict[frozenset, tuple] = {}
    occurrences = []
    for i, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(words(lower(line)))
            if len(s) >= least:
                occurrences.append((i, k, s))
                first.setdefault(s, (i, k))
    order = sorted(first, key=first.get)
    gone = {s for n, s in enumerate(order) if any(100 * len(s & t) >= percent * len(s | t) for t in order[:n])}
    out = defaultdict(set)
    for i, k, s in occurrences:
        if s in gone or first[s] != (i, k):
            out[i].add(k)
    return out


def noisy_copies(seed: int, groups: int, size: int, edits: int, n_words: int = 60) -> list[tuple[int, str]]:
    """Groups of texts that differ in a few words from one another."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(n_words)]
        for k in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(n_words)] = rng.choice(vocabulary)
            out.append((len(out) * 7 % 10_007, " ".join(w)))
    return out
