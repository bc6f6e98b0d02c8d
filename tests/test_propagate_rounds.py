"""Propagation along chains: what a round writes, and its pairs against a plain loop."""

import random
from collections import Counter, defaultdict

from hoptrail.operators import joins


def plain(seeds, old, new):
    done = set(seeds)
    while True:
        proposals = []
        for edges, own in ((old, 0), (new, 1)):
            mapped, at = {p[own] for p in done}, defaultdict(list)
            for s, d, t in edges:
                if d not in mapped:
                    at[s, t].append(d)
            proposals.append({(p, t): at[p[own], t][0] for p in done for t in {t for s, t in at if s == p[own]} if len(at[p[own], t]) == 1})
        pairs = {(proposals[0][k], proposals[1][k]) for k in proposals[0].keys() & proposals[1].keys()}
        a, b = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
        more = {p for p in pairs if a[p[0]] == 1 and b[p[1]] == 1}
        if not more:
            return done
        done |= more


def test_rounds(spark, monkeypatch):
    rng = random.Random(5)
    old = sorted({(i, i + 1, "x") for i in range(60) if i % 12 < 10} | {(rng.randrange(60), rng.randrange(60), rng.choice("xy")) for _ in range(30)})
    new = [(s + 100, d + 100, t) for s, d, t in old if rng.random() < 0.9]
    seeds = [(i, i + 100) for i in range(0, 60, 12)]
    written, write = [], joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long, type string")
    for part in (1 / 32, 10.0):
        monkeypatch.setattr(joins, "REWRITE", part)
        written.clear()
        found = joins.propagate(spark.createDataFrame(seeds, "o long, n long"), joins.both_ways(table(old)), joins.both_ways(table(new)))
        ways = lambda edges: [(s, d, "out:" + t) for s, d, t in edges] + [(d, s, "in:" + t) for s, d, t in edges]
        assert {tuple(r) for r in found.collect()} == plain(seeds, ways(old), ways(new)) and found.count() > len(seeds)
    assert written.count("edges") == 2 and written.count("pairs") > 3  # one writing of each side's edges for all rounds
