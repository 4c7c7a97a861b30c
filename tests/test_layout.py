"""Layered drawings against plain loops."""

import random
from collections import defaultdict

from gridlineage.operators import layout


def plain(nodes, edges, passes):
    """Levels, turned links, places and lines of one workbook by loops."""
    links = sorted({(a, b) for a, b in edges if a != b and a in nodes and b in nodes})
    level, left, k = {}, set(links), 0
    while len(level) < len(nodes):
        rest = nodes - set(level)
        free = rest - {b for _, b in left} or {min(rest)}
        level |= dict.fromkeys(free, k)
        left = {(a, b) for a, b in left if a not in free and b not in free}
        k += 1
    at_level, near, lines = defaultdict(set), defaultdict(list), {}
    for n, i in level.items():
        at_level[i].add(n)
    for a, b in links:
        top, low = (a, b) if level[a] < level[b] else (b, a)
        chain = [top, *[f"b:{a}>{b}#{i}" for i in range(level[top] + 1, level[low])], low]
        for i, n in enumerate(chain):
            at_level[level[top] + i].add(n)
        for u, l in zip(chain, chain[1:]):
            near[l, 0].append(u)
            near[u, 1].append(l)
        lines[a, b] = (level[a] > level[b], chain)
    order = {i: sorted(ns) for i, ns in at_level.items()}
    for p in range(passes + 1):
        at = {n: (2 * r + 1) * layout.HEIGHT // (2 * len(ns)) for ns in order.values() for r, n in enumerate(ns)}
        if p < passes:
            mean = {n: sum(at[m] for m in near[n, p % 2]) // len(near[n, p % 2]) if near[n, p % 2] else at[n] for n in at}
            order = {i: sorted(ns, key=lambda n: (mean[n], at[n])) for i, ns in order.items()}
    return level, at, lines


def graphs():
    rng = random.Random(3)
    yield "chain", {f"n{i}" for i in range(6)}, [(f"n{i}", f"n{j}") for i in range(6) for j in range(i + 1, 6) if rng.random() < 0.6]
    yield "circle", set("abcdef"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("a", "gone"), ("a", "b")]
    yield "lone", {"x", "y"}, []
    many = [f"m{i}" for i in range(40)]
    yield "many", set(many), [tuple(sorted(rng.sample(many, 2))) for _ in range(70)]


def test_drawings(spark):
    cases = {name: (nodes, edges) for name, nodes, edges in graphs()}
    nodes = spark.createDataFrame([(w, n, "kept") for w, (ns, _) in cases.items() for n in ns], "workbook_id string, id string, at string")
    edges = spark.createDataFrame([(w, a, b, 1) for w, (_, es) in cases.items() for a, b in es], "workbook_id string, src string, dst string, level int")
    places, lines = layout.drawing(nodes, edges)
    places, lines = places.collect(), lines.collect()
    assert len(places) == sum(len(ns) for ns, _ in cases.values())
    for w, (ns, es) in cases.items():
        level, at, drawn = plain(ns, es, layout.PASSES)
        assert {r.id: (r.level, r.at) for r in places if r.workbook_id == w} == {n: (level[n], at[n]) for n in ns}
        own = {(r.src, r.dst): (r.turned, [tuple(p) for p in r.points]) for r in lines if r.workbook_id == w}
        top = {k: min(level[k[0]], level[k[1]]) for k in drawn}
        assert own == {k: (t, [(top[k] + i, at[n]) for i, n in enumerate(chain)]) for k, (t, chain) in drawn.items()}


def test_a_pass_untangles(spark):
    nodes = spark.createDataFrame([("w", f"{c}{i}") for c in "ab" for i in range(5)], "workbook_id string, id string")
    edges = spark.createDataFrame([("w", f"a{i}", f"b{4 - i}") for i in range(5)], "workbook_id string, src string, dst string")
    at = {r.id: r.at for r in layout.drawing(nodes, edges, passes=1)[0].collect()}
    assert all(at[f"a{i}"] == at[f"b{4 - i}"] for i in range(5))


def test_empty_drawing(spark):
    nodes, edges = spark.createDataFrame([], "workbook_id string, id string"), spark.createDataFrame([], "workbook_id string, src string, dst string")
    places, lines = layout.drawing(nodes, edges)
    assert places.count() == lines.count() == 0
