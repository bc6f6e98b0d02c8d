"""Queries and operators without SQL against brute force."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hoptrail.operators import graph, joins
from hoptrail.plans import whole

SF = "/root/testdata/sf0.001"


def brute_pairs(pairs, old, new):
    """Mapped pairs grown in rounds along (src, dst, type) until a round adds none."""
    pairs = set(pairs)
    while True:
        o_done, n_done = {o for o, _ in pairs}, {n for _, n in pairs}

        def ahead(edges, done):
            found = defaultdict(list)
            for a, b, t in edges:
                if b not in done:
                    found[a, t].append(b)
            return {k: v[0] for k, v in found.items() if len(v) == 1}

        x, y = ahead(old, o_done), ahead(new, n_done)
        kinds = {t for _, t in x}
        both = {(x[o, t], y[n, t]) for o, n in pairs for t in kinds if (o, t) in x and (n, t) in y}
        a, b = Counter(o for o, _ in both), Counter(n for _, n in both)
        more = {(o, n) for o, n in both if a[o] == 1 and b[n] == 1}
        if not more:
            return pairs
        pairs |= more


def brute_both(edges):
    return {(a, b, f"out:{t}") for a, b, t in edges} | {(b, a, f"in:{t}") for a, b, t in edges}


def test_propagate_until_stable(spark):
    old = [(i, i + 1, "x") for i in range(9)] + [(3, 20, "y"), (3, 21, "y"), (20, 30, "z")]
    new = [(a + 100, b + 100, t) for a, b, t in old] + [(105, 140, "x")]
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long, type string")
    m = spark.createDataFrame([(0, 100)], "o long, n long")
    got = {tuple(r) for r in joins.propagate(m, e(old), e(new)).collect()}
    assert got == brute_pairs({(0, 100)}, old, new) == {(i, i + 100) for i in range(6)}
    none = joins.propagate(m.limit(0), e(old), e(new))
    assert none.count() == 0


def test_propagate_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_returnflag").distinct().collect()]
    m = max(k for k, _ in rows) + 1
    old = brute_both({(k, k * 3 % m, t) for k, t in rows})
    new = brute_both({(k + 10000, k * 3 % m + 10000, t) for k, t in rows if k % 11})
    want = brute_pairs({(k, k + 10000) for k, _ in rows if k % 4 == 0}, old, new)
    out = whole.q_neighbor_propagate_whole(spark, SF).collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    assert max(o for o, _ in want) > 997


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_fingerprint(labels, edges):
    """Colours from (mark, flow, more...) and degrees, refined, then hashed with the edges."""
    joined = lambda parts: sha("\x1f".join(map(str, parts)))
    ins, outs = Counter(b for _, b, _ in edges), Counter(a for a, _, _ in edges)
    colours = {v: joined([*x[:2], ins[v], outs[v], *x[2:]]) for v, x in labels.items()}
    for _ in range(min(max(len(labels), 1), 8)):
        part = lambda v, at, to: sorted(f"{e[2]}:{colours[e[to]]}" for e in edges if e[at] == v)  # noqa: B023, E731
        colours = {v: joined([c, "IN", *part(v, 1, 0), "OUT", *part(v, 0, 1)]) for v, c in colours.items()}
    return joined(["NODES", len(labels), *sorted(colours.values()), "EDGES", len(edges), *sorted(f"{colours[a]}:{t}:{colours[b]}" for a, b, t in edges)])


def test_fingerprint_sees_far_and_edges(spark):
    """Two paths whose marks lie six and seven steps apart look alike within two steps; one edge type more is one more graph."""
    nodes = [(g, i, "mark" if i in (6, 12 + g) else "plain") for g in (0, 1) for i in range(20)] + [(g, i, "plain") for g in (2, 3) for i in range(1)]
    edges = [(g, i, i + 1, "x") for g in (0, 1) for i in range(19)] + [(3, 0, 0, "x")]
    n, e = spark.createDataFrame(nodes, "g long, node long, name string"), spark.createDataFrame(edges, "g long, src long, dst long, type string")
    got = {r.g: r.fingerprint for r in graph.fingerprint(n, e, "g", [F.lit("NODE"), F.lit("f"), F.col("name")]).collect()}
    want = {g: brute_fingerprint({v: ("NODE", "f", x) for h, v, x in nodes if h == g}, [(a, b, t) for h, a, b, t in edges if h == g]) for g in range(4)}
    assert got == want and len(set(got.values())) == 4


def test_fingerprint_query(spark):
    rows = {(r[0] % 40, r[1] % 12, r[2] % 12, r[3]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        edges = [r[1:] for r in rows if r[0] == g]
        want[g] = brute_fingerprint({v: ("NODE" if v else "ENTRY", "flow", v % 3) for v in {x for e in edges for x in e[:2]}}, edges)
    assert {r.g: r.fingerprint for r in whole.q_wl_fingerprint_whole(spark, SF).collect()} == want


def test_four_hashes(spark):
    """Layout in order of offsets and of edges; topology, mnemonic and instruction hashes; a function without blocks."""
    blocks = [("f", "b1", 0, 8, 2, "jump", "m1", "i1"), ("f", "b2", 8, 4, 1, "terminal", "m2", "i2"), ("f", "b0", 100, 4, 1, "terminal", "m2", "i3")]
    edges = [("f", "b1", "b2", "fallthrough"), ("f", "b1", "b0", "conditional_taken")]
    b = spark.createDataFrame(blocks, "function string, block string, relative_offset long, address_count long, instruction_count long, terminal_flow string, mnemonic_hash string, instruction_hash string")
    e = spark.createDataFrame(edges, "function string, src string, dst string, type string")
    got = {r.function: r for r in graph.cfg_hashes(spark.createDataFrame([("f",), ("none",)], "function string"), b, e).collect()}
    at = {x[1]: x for x in blocks}
    layout = [f"B:{x[2]}:{x[3]}:{x[4]}" for x in sorted(blocks, key=lambda x: x[2])] + [f"E:{at[s][2]}:{at[d][2]}:{t}" for _, s, d, t in sorted(edges)]
    assert got["f"].layout_hash == sha("\x1f".join(layout))
    for name, more in (("topology_hash", 8), ("mnemonic_hash", 6), ("instruction_hash", 7)):
        want = brute_fingerprint({x[1]: ("NODE" if x[2] else "ENTRY", x[5], *x[more : more + 1]) for x in blocks}, [x[1:] for x in edges])
        assert got["f"][name] == want
        assert got["none"][name] == sha("EMPTY_GRAPH")
