"""The trie against a plain version, with buckets small enough that most of it is made by the distributed rounds."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from talweg.llm import prefixtrie
from talweg.llm.common import table

from .cases import words

SCHEMA = "conv_id long, turn long, role string, text string, id string, digit int"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append((c, d == len(seq)))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(words(p[-1][1])) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c, end in sorted(members) if end)
        parent = min(nodes[p[:-1]])[0] if p else None
        out.append((min(members)[0], len(p), parent, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie(spark, rows, cfg):
    turns = spark.createDataFrame(rows, SCHEMA)
    out = prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.encoded(turns)), cfg).collect()
    return sorted(tuple(r) for r in out)


def edge_rows():
    rng = random.Random(4)
    said = [f"line {k} of {k % 5} words" + " more" * (k % 4) for k in range(9)]
    rows = []
    for c in [*range(60), -3, -40, 1 << 61]:
        for t in range(rng.randrange(7)):
            rows.append((c, t, rng.choice(["user", "bot"]) if t else "user", said[0] if t == 0 else rng.choice(said), "x", 1))
    for c in range(100, 140):  # the same first turns, then a few ends, and many copies
        rows += [(c, t, "user", f"same {t}", "x", 1) for t in range(3 + (c % 3 == 0))]
    for c in range(200, 206):  # ever longer ones
        rows += [(c, t, "user", f"long {t}", "x", 1) for t in range(4 + 10 * (c - 200))]
    rows += [(7, None, None, None, "x", 1), (7, None, "user", "", "x", 1), (7, 3, "user", said[1], "x", 1), (7, 3, "user", said[1], "x", 1), (None, 1, "user", "lost", "x", 1), (300, 1, None, None, None, None)]
    return rows


@pytest.mark.parametrize(("digit", "local"), [(2, 4), (12, 1 << 14), (3, 60)])
def test_trie_equals_a_plain_one(spark, digit, local):
    rows = edge_rows()
    assert trie(spark, rows, prefixtrie.TrieConfig(digit=digit, local=local, chunk=3)) == plain(rows)


def test_no_and_one_conversation(spark):
    assert trie(spark, [], prefixtrie.TrieConfig()) == []
    assert trie(spark, [(None, 1, "a", "b", "x", 1)], prefixtrie.TrieConfig()) == []
    for one in ([(20, 1, "a", "b c", "x", 1)], [(1, 1, "a", "b c", "x", 1), (1, 2, "a", "b c", "x", 1)]):
        assert trie(spark, one, prefixtrie.TrieConfig()) == plain(one)


def test_conversations_of_the_table(spark):
    rows = [tuple(r) + (None, None) for r in table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert trie(spark, rows, prefixtrie.TrieConfig(digit=4, local=10)) == plain(rows)
