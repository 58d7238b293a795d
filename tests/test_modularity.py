"""Communities by gain of modularity, against a plain version of the same levels."""

import random

import pytest

from talweg.operators.modularity import communities, modularity, undirected


def coin(c, level):
    x = (c * 48271 + 7919 * (level + 1)) % 2147483647
    return x * 69621 % 2147483647 // 65536 % 2 == 0


def score(links, label):
    total = 2 * sum(links.values())
    k, inside = {}, 0
    for (a, b), w in links.items():
        for n in (a, b):
            k[label[n]] = k.get(label[n], 0) + w
        inside += 2 * w * (label[a] == label[b])
    return inside / total - sum(v * v for v in k.values()) / total / total


def plain(links, nodes):
    label, graph, level = {n: n for n in nodes}, dict(links), 0
    total, history = 2 * sum(links.values()), []
    k = {}
    for (a, b), w in links.items():
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    while k:
        history.append((len(k), score(links, label)))
        best = {}
        for (a, b), w in graph.items():
            gain = total * w - k[a] * k[b]
            for c, to in ((a, b), (b, a)):
                if gain > 0:
                    best[c] = max(best.get(c, (0,)), (gain, -a, -b, w, to))
        if not best:
            break
        to = {c: b[-1] for c, b in best.items()}
        hub = {c: c < t if to[t] == c else coin(c, level) for c, t in to.items()}
        asks = {}
        for c, t in to.items():
            if not hub[c] and hub[t]:
                asks.setdefault(t, []).append(c)
        joins = {}
        for t, cs in asks.items():
            others, top = sum(k[c] for c in cs), max(cs, key=lambda c: (best[c][0], -c))
            joins |= {c: t for c in cs if c == top or total * best[c][3] - k[c] * (k[t] + others - k[c]) > 0}
        label = {n: joins.get(c, c) for n, c in label.items()}
        new, sizes = {}, {}
        for (a, b), w in graph.items():
            a, b = sorted((joins.get(a, a), joins.get(b, b)))
            if a < b:
                new[a, b] = new.get((a, b), 0) + w
        for c, v in k.items():
            sizes[joins.get(c, c)] = sizes.get(joins.get(c, c), 0) + v
        graph, k, level = new, sizes, level + 1
    least = {}
    for n in sorted(nodes):
        least.setdefault(label[n], n)
    return {n: least[c] for n, c in label.items()}, history


def shapes():
    rng = random.Random(5)
    planted = [(a, b) for a in range(80) for b in range(a) if rng.random() < (0.5 if a // 16 == b // 16 else 0.02)]
    return {
        "planted": planted,
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 50)],
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(200)],
        "two": [(1, 2), (2, 1), (1, 1)],
    }


@pytest.mark.parametrize("name", shapes())
def test_communities(spark, name):
    edges = shapes()[name]
    links = {}
    for a, b in edges:
        if a != b:
            links[min(a, b), max(a, b)] = links.get((min(a, b), max(a, b)), 0) + 1
    nodes = sorted({n for e in edges for n in e} | {500})  # 500 has no links
    df = spark.createDataFrame(edges, "node long, nb long")
    got, history = communities(df, spark.createDataFrame([(n,) for n in nodes], "node long"))
    label = {r.node: r.community for r in got.collect()}
    want, levels = plain(links, nodes)
    assert label == want
    assert history == [(n, pytest.approx(q)) for n, q in levels]
    assert all(a[1] < b[1] for a, b in zip(history, history[1:]))
    assert modularity(undirected(df), got).first()[0] == pytest.approx(score(links, label)) == pytest.approx(history[-1][1])
    if name == "planted":
        assert all(label[n] == n // 16 * 16 for n in range(80))


def test_no_links(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    none = spark.createDataFrame([(1, 1)], "node long, nb long")
    got, history = communities(none, nodes)
    assert sorted((r.node, r.community) for r in got.collect()) == [(1, 1), (2, 2)] and history == []
    assert modularity(undirected(none), got).first()[0] is None


@pytest.mark.parametrize(("side", "around", "few"), [(16, 12, 1 << 18), (16, 14, 200), (24, 1, 1000)])
def test_tiles_and_the_last_task_change_nothing(spark, monkeypatch, side, around, few):
    from talweg.functions.grid import GridSpec
    from talweg.operators import modularity as m

    spec, rng = GridSpec(45, 33), random.Random(7)
    here = [n for n in range(spec.size - 20) if rng.random() < 0.95]
    inside, edges = set(here), []
    for n in here:
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            r, c = n // 45 + dr, n % 45 + dc
            if 0 <= c < 45 and r * 45 + c in inside:
                edges += [(n, r * 45 + c), (r * 45 + c, n)]
    links = {(a, b): 2.0 for a, b in edges if a < b}
    want, levels = plain(links, here)
    tables, told = [], []
    cut, by_tiles = m.cut, m._by_tiles
    monkeypatch.setattr(m, "TILE", side)
    monkeypatch.setattr(m, "AROUND", around)
    monkeypatch.setattr(m, "FEW_LINKS", few)
    monkeypatch.setattr(m, "cut", lambda df: tables.append(1) or cut(df))
    monkeypatch.setattr(m, "_by_tiles", lambda *a: told.append(by_tiles(*a)) or told[-1])
    got, history = communities(spark.createDataFrame(edges, "node long, nb long"), spark.createDataFrame([(n,) for n in here], "node long"), spec=spec)
    assert {r.node: r.community for r in got.collect()} == want
    assert history == [(n, pytest.approx(q)) for n, q in levels]
    done = [d for _, d in told]
    assert bool(done) == (few <= len(links)) and (not done or (done[0] > 0) == (around > 1))
    assert len(tables) <= 8 or few < 1 << 18
