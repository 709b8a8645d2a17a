"""Shortest paths from both ends: those of a plain search, without walking the whole graph for each pair."""

import numpy as np
from test_scoring import shuffled_rows

from corpusloom.operators import graph as G


def plain_path(after: dict, source: int, target: int):
    level, seen = {source: [source]}, {source}
    while level:
        if target in level:
            return level[target]
        nxt: dict = {}
        for v, path in level.items():
            for w in after.get(v, ()):
                if w not in seen and path + [w] < nxt.get(w, [float("inf")]):
                    nxt[w] = path + [w]
        seen |= nxt.keys()
        level = nxt
    return None


def test_paths_of_both_ends(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 3000, (12_000, 2)) if a != b and b % 100 and a % 97})
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (40, 2))] + [(5, 5), (1, 100), (97, 3)]
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    want = {(s, t): plain_path(after, s, t) for s, t in pairs}
    want |= {(s, t): plain_path(after, t, s) for (s, t), path in want.items() if path is None}
    before = shuffled_rows(spark)
    got = {(r["source"], r["target"]): r["path"] for r in G.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert got == {pair: path for pair, path in want.items() if path is not None}
    assert shuffled_rows(spark) - before < 60_000
