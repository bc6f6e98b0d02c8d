"""The diff of two versions and the static tables against brute force."""

from collections import defaultdict

import pytest

from hoptrail.operators import cfg, diff
from hoptrail.plans import whole

SF = "/root/testdata/sf0.001"


def likeness(a, b, da, db):
    s = 0.30 * (a.instruction_hash == b.instruction_hash) + 0.25 * (a.mnemonic_hash == b.mnemonic_hash) + 0.15 * (a.terminal_flow == b.terminal_flow)
    s += 0.15 / (1 + abs(da[0] - db[0]) + abs(da[1] - db[1])) + 0.10 * (1 - abs(a.instruction_count - b.instruction_count) / max(a.instruction_count, b.instruction_count, 1))
    return round(s + 0.05 * (a.relative_offset == b.relative_offset), 9)


def brute_map(old, old_edges, new, new_edges):
    """Block of the old version to (block of the new one, method), for one function."""
    deg = lambda blocks, edges: {b: (sum(e[1] == b for e in edges), sum(e[0] == b for e in edges)) for b in blocks}
    do, dn = deg(old, old_edges), deg(new, new_edges)
    out, back = {}, {}

    def add(o, n, method):
        out[o], back[n] = (n, method), o

    def unique(key, method):
        a, b = defaultdict(list), defaultdict(list)
        for x, d, group, done in ((old, do, a, out), (new, dn, b, back)):
            for k, v in x.items():
                if k not in done:
                    group[key(v, d[k])].append(k)
        for k in a.keys() & b.keys():
            if len(a[k]) == len(b[k]) == 1:
                add(a[k][0], b[k][0], method)

    def grow():
        while True:
            found = defaultdict(set)
            for o, (n, _) in out.items():
                for way, (s, d) in (("in", (1, 0)), ("out", (0, 1))):
                    x, y = defaultdict(list), defaultdict(list)
                    for e in old_edges:
                        if e[s] == o and e[d] not in out:
                            x[e[2]].append(e[d])
                    for e in new_edges:
                        if e[s] == n and e[d] not in back:
                            y[e[2]].append(e[d])
                    for t in x.keys() & y.keys():
                        if len(x[t]) == len(y[t]) == 1:
                            found[x[t][0], y[t][0]].add(way)
            sole = [p for p in found if sum(q[0] == p[0] for q in found) == 1 and sum(q[1] == p[1] for q in found) == 1]
            for o, n in sole:
                add(o, n, f"mapped_neighbor_{max(found[o, n])}")
            if not sole:
                return

    def best(own, other, score):
        ranked = sorted(((-score(own, x), x) for x in other))
        if not ranked or -ranked[0][0] < 0.60 or len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 0.05:
            return None
        return ranked[0][1]

    entry = [[k for k, v in side.items() if v.relative_offset == 0] for side in (old, new)]
    if len(entry[0]) == len(entry[1]) == 1:
        add(entry[0][0], entry[1][0], "entry")
    unique(lambda v, d: (v.instruction_hash, v.terminal_flow, d), "unique_instruction_block")
    unique(lambda v, d: (v.mnemonic_hash, v.terminal_flow, d), "unique_mnemonic_block")
    grow()
    unique(lambda v, d: (v.mnemonic_hash, v.terminal_flow, d, v.relative_offset), "same_relative_structure")
    while True:
        a, b = [k for k in old if k not in out], [k for k in new if k not in back]
        score = lambda o, n: likeness(old[o], new[n], do[o], dn[n])
        one = {o: best(o, b, score) for o in a}
        two = {n: best(n, a, lambda x, y: score(y, x)) for n in b}
        more = [(o, n) for o, n in one.items() if n is not None and two.get(n) == o]
        for o, n in more:
            add(o, n, "mutual_best_similarity")
        if not more:
            return out
        grow()


def brute_edges(mapping, old_edges, new_edges):
    left, rows, gone = set(new_edges), [], []
    for e in sorted(old_edges):
        if e[0] in mapping and e[1] in mapping:
            a, b = mapping[e[0]][0], mapping[e[1]][0]
            if (a, b, e[2]) in left:
                left.remove((a, b, e[2]))
                continue
            some = [x for x in left if x[:2] == (a, b)]
            if len(some) == 1 and not any((a, b, x[2]) in set(new_edges) and x[2] == some[0][2] for x in old_edges if x != e and x[0] in mapping and x[1] in mapping and (mapping[x[0]][0], mapping[x[1]][0]) == (a, b)):
                left.remove(some[0])
                rows.append(("TYPE_CHANGED", *e, *some[0]))
                continue
        gone.append(e)
    return rows + [("REMOVED", *e, None, None, None) for e in gone] + [("ADDED", None, None, None, *e) for e in left]


@pytest.fixture(scope="module")
def sides(spark):
    by = [defaultdict(dict), defaultdict(set), defaultdict(dict), defaultdict(set)]
    for store, df in zip(by, whole.function_versions(spark, SF), strict=True):
        for r in df.collect():
            if "block" in df.columns:
                store[r.pair_id][str(r.block)] = r
            else:
                store[r.pair_id].add((str(r.src), str(r.dst), r.type))
    return by


def test_blocks_and_edges(spark, sides):
    old, old_edges, new, new_edges = sides
    maps = {p: brute_map(old[p], old_edges[p], new[p], new_edges[p]) for p in old}
    want = set()
    for p, m in maps.items():
        for o, b in old[p].items():
            n, method = m.get(o, (None, None))
            same = n and b.instruction_hash == new[p][n].instruction_hash
            stays = n and b.relative_offset == new[p][n].relative_offset
            status = "REMOVED" if n is None else {(True, True): "UNCHANGED", (True, False): "MOVED", (False, True): "MODIFIED", (False, False): "MODIFIED_MOVED"}[same, stays]
            want.add((p, status, method, o, n))
        want |= {(p, "ADDED", None, None, n) for n in new[p] if n not in {x for x, _ in m.values()}}
    text = lambda x: None if x is None else str(x)
    got = [(r.pair_id, r.status, r.method, text(r.old_block), text(r.new_block)) for r in whole.q_block_diff(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {x[1] for x in want} >= {"UNCHANGED", "MOVED", "MODIFIED", "REMOVED"}
    edges = {(r.pair_id, r.status, r.old_src, r.old_dst, r.old_type, r.new_src, r.new_dst, r.new_type) for r in whole.q_edge_rows(spark, SF).collect()}
    assert edges == {(p, *row) for p, m in maps.items() for row in brute_edges(m, old_edges[p], new_edges[p])}


def test_summaries(spark):
    pairs = spark.createDataFrame([(i, "OK" if i != 5 else "FAILED", "PARTIAL" if i == 6 else "OK", "l", "l2" if i == 3 else "l", "t", "t2" if i == 1 else "t", "i", "i2" if i == 2 else "i") for i in range(8)], "pair_id long, old_status string, new_status string, old_layout_hash string, new_layout_hash string, old_topology_hash string, new_topology_hash string, old_instruction_hash string, new_instruction_hash string")
    blocks = spark.createDataFrame([(4, "REMOVED", None), (0, "UNCHANGED", "entry"), (7, "UNCHANGED", "entry")], "pair_id long, status string, method string")
    edges = spark.createDataFrame([(7, "ADDED")], "pair_id long, status string")
    got = {r.pair_id: r.status for r in diff.summaries(pairs, blocks, edges).collect()}
    assert got == {0: "UNCHANGED", 1: "CFG_CHANGED", 2: "CONTENT_ONLY", 3: "LAYOUT_ONLY", 4: "BLOCK_MAPPING_AMBIGUOUS", 5: "ANALYSIS_FAILED", 6: "ANALYSIS_PARTIAL", 7: "CFG_CHANGED"}


def test_match_rows(spark):
    f = lambda rows: spark.createDataFrame(rows, "name string, entry string, signature string")
    old, new = f([("a", "1", "x"), ("b", "2", "x"), ("b", "3", "y"), ("c", "4", "z")]), f([("a", "11", "x"), ("b", "12", "v"), ("b", "13", "w"), ("d", "14", "q")])
    matches = spark.createDataFrame([("1", "11", "name", "high")], "old_entry string, new_entry string, method string, confidence string")
    got = sorted((r.status, r.name, r.old_entry, r.new_entry, r.old_signature, r.pair_id) for r in diff.match_rows(old, new, matches).collect())
    assert got == [("AMBIGUOUS", "b", "2;3", "12;13", "x;y", None), ("MATCHED", "a", "1", "11", "x", "F000001"), ("NEW_ONLY", "d", None, "14", None, None), ("OLD_ONLY", "c", "4", None, "z", None)]


def test_static_tables(spark):
    kind = "function long, block long, address long, mnemonic string, operands array<string>, returns boolean, call boolean, jump boolean, conditional boolean, computed boolean, terminal boolean, fallthrough long, targets array<long>, last boolean, text string"
    no, yes = False, True
    facts = [
        (100, 100, 100, "cmp", [], no, no, no, no, no, no, 104, [], no, "cmp"),
        (100, 100, 104, "b.eq", [], no, no, yes, yes, no, no, 108, [200], yes, "b.eq"),
        (100, 108, 108, "bl", [], no, yes, no, no, no, no, 112, [300], yes, "bl"),
        (100, 112, 112, "blr", [], no, yes, no, no, yes, no, 116, [], yes, "blr"),
        (100, 116, 116, "br", [], no, no, yes, no, yes, yes, None, [200], yes, "br"),
        (100, 200, 200, "ret", [], yes, no, no, no, no, yes, None, [], yes, "ret"),
        (300, 300, 300, "b", [], no, no, yes, no, no, no, None, [100], yes, "b"),
    ]
    df = spark.createDataFrame(facts, kind)
    there = spark.createDataFrame([(a[2], a[0], a[1]) for a in facts], "address long, place_function long, place_block long")
    model = spark.createDataFrame([(100, 100, 104, 200, no, yes, yes, no, no, no), (100, 100, 104, 108, no, no, no, no, no, yes), (100, 200, 200, 300, no, no, no, no, yes, no)], "function long, block long, source long, destination long, call boolean, jump boolean, conditional boolean, computed boolean, terminal boolean, is_fallthrough boolean")
    t = cfg.tables(df, model, there, spark.createDataFrame([(116,)], "address long"))
    edges = {(r.src_address, r.dst_address, r.type, r.confidence, r.interprocedural) for r in t.edges.collect()}
    assert edges == {(104, 200, "conditional_taken", "high", no), (104, 108, "conditional_not_taken", "high", no), (108, 300, "direct_call", "high", yes), (108, 112, "call_fallthrough", "high", no), (112, 116, "call_fallthrough", "high", no), (116, 200, "indirect_jump", "medium", no), (300, 100, "tail_call", "high", yes)}
    calls = {(r.call_site, r.callee, r.kind, r.continuation, r.confidence) for r in t.call_sites.collect()}
    assert calls == {(108, 300, "direct_call", 112, "high"), (112, None, "indirect_call", 116, "low"), (300, 100, "tail_call", None, "high")}
    assert {(r.caller, r.callee, r.kind) for r in t.call_graph.collect()} == {(100, 300, "direct_call"), (300, 100, "tail_call")}
    assert [(r.address, r.kind, r.detection) for r in t.return_sites.collect()] == [(200, "return", "pcode")]
    sites = {(r.address, r.kind, r.status, tuple(r.targets)) for r in t.indirect_sites.collect()}
    assert sites == {(112, "indirect_call", "unresolved", ()), (116, "indirect_jump", "resolved", (200,))}
    with pytest.raises(ValueError):
        cfg.check_versions({"language_id": "a", "compiler_spec": "x"}, {"language_id": "b", "compiler_spec": "x"})
    assert len(cfg.check_versions({"language_id": "a", "compiler_spec": "x"}, {"language_id": "a", "compiler_spec": "y"})) == 1


def test_return_stack(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    want, stacks = {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id)):
        stack, popped = stacks[r.user_id], None
        if r.event_type == "view":
            stack.append(r.event_id * 4)
            del stack[:-8]
        elif r.event_type == "purchase":
            popped = stack.pop() if stack else None
        want[r.event_id] = (popped, len(stack))
    assert {r.row_id: (r.popped, r.depth) for r in whole.q_return_stack(spark, SF).collect()} == want


def test_mapped_functions_take_no_part_in_growth(spark, monkeypatch):
    from hoptrail.operators import diff

    # Function 1 is mapped by its hashes; in function 2 block 2's hashes and shape changed, so only growth finds it.
    rows = lambda two: [(1, 1, 0, "f", 4, 1, "m1", "i1"), (1, 2, 8, "f", 4, 1, "m2", "i2"), (2, 1, 0, "f", 4, 1, "m1", "i1"), (2, 2, 8, *two)]
    names = "pair_id int, block int, relative_offset long, terminal_flow string, address_count long, instruction_count long, mnemonic_hash string, instruction_hash string"
    edges = spark.createDataFrame([(1, 1, 2, "t"), (2, 1, 2, "t")], "pair_id int, src int, dst int, type string")
    sides = [diff.Side.of(spark.createDataFrame(rows(two), names), edges, "x") for two in (("f", 4, 1, "m2", "i2"), ("g", 9, 7, "m9", "i9"))]
    seen, whole = [], diff.propagate
    monkeypatch.setattr(diff, "propagate", lambda pairs, a, b, **kw: seen.append({r.src.split(diff.SEP)[0] for e in (a, b) for r in e.collect()}) or whole(pairs, a, b, **kw))
    got = {(r.o.replace(diff.SEP, "."), r.n.replace(diff.SEP, "."), r.method) for r in diff.map_blocks(*sides).collect()}
    assert got == {("1.1", "1.1", "entry"), ("2.1", "2.1", "entry"), ("1.2", "1.2", "unique_instruction_block"), ("2.2", "2.2", "mapped_neighbor_out")}
    assert seen == [{"2"}]
