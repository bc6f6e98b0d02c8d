"""Lines of large files read in many tasks, events and segments on them, and symbols of addresses."""

import json
import random

import pytest

from hoptrail.operators import cfg, joins
from hoptrail.sources import batch, traces


def test_lines_of_a_split_file(spark, tmp_path):
    rng = random.Random(1)
    for name, n in (("a.txt", 4_000), ("b.txt", 3), ("empty.txt", 0)):
        with open(tmp_path / name, "w", newline="") as out:
            for i in range(n):
                out.write(rng.choice(["", "  ", f"{i} {'x' * rng.randint(0, 90)}", f"\t {i}é "]) + rng.choice(["\n", "\r\n"]))
    (tmp_path / "other.log").write_text("no\n")
    want = {}
    for name in ("a.txt", "b.txt"):
        with open(tmp_path / name) as lines:
            want |= {(name, i): s for i, line in enumerate(lines, 1) if (s := line.strip())}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1000b", before["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100b")
            out = traces.read_lines(spark, str(tmp_path))
            assert {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in out.collect()} == want
            assert spark.read.option("pathGlobFilter", "*.txt").text(str(tmp_path)).rdd.getNumPartitions() > 20 or size != "1000b"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_events_and_segments(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.jsonl").write_text('{"event": "address", "address": "0x10", "elf_va": "0x1"}\n\n{"event": "header", "modules": ["m"]}\n')
    out = traces.read_events(spark, str(tmp_path / "e")).orderBy("event_index").collect()
    assert [(r.event_index, r.event, r.address, r.elf_va, r.modules) for r in out] == [(1, "address", "0x10", "0x1", None), (3, "header", None, None, ["m"])]
    (tmp_path / "s").mkdir()
    segment = {"segment_id": 4, "length": 1, "start": {"module": "m"}, "tokens": [{"ctrl": {"kind": "return", "atom": "E"}}]}
    (tmp_path / "s" / "a.jsonl").write_text(json.dumps(segment) + "\n")
    r = traces.read_segments(spark, str(tmp_path / "s")).first()
    assert (r.segment_id, r.start.module, r.tokens[0].ctrl.kind) == (4, "m", "return")
    traces.write_json_lines(spark.createDataFrame([(1, "x", None)], "a int, b string, c string"), str(tmp_path / "w"))
    assert traces.read_lines(spark, str(tmp_path / "w"), "*").first().line == '{"a":1,"b":"x"}'
    for bad in ("{broken", "no object"):
        (tmp_path / "s" / "a.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            traces.read_segments(spark, str(tmp_path / "s")).collect()


def brute_symbol(symbols, va, near=8):
    """(name, offset, contains) as a search in a sorted list."""
    own = sorted(symbols, key=lambda s: (s[1], -s[2], s[0]))
    last = max((i for i, s in enumerate(own) if s[1] <= va), default=None)
    if last is None:
        return None, None, False
    some = own[max(0, last - near) : last + 1]
    hold = [s for s in some if (s[1] <= va < s[1] + s[2] if s[2] else s[1] == va)]
    if hold:
        s = min(hold, key=lambda s: (s[3] not in joins.FUNCTIONS, s[2] or 1 << 62, -s[1], s[0]))
        return s[0], va - s[1], True
    s = next(s for s in some if s[1] == own[last][1])
    return s[0], va - s[1], False


def test_symbols(spark):
    rng = random.Random(2)
    symbols = [(rng.choice("ab"), f"f{i}", rng.randrange(0, 600), rng.choice([0, 0, 4, 30, 200]), rng.choice([0, 1, 2, 10])) for i in range(150)]
    points = [(i, rng.choice(["a", "b", "none", None]), rng.choice([rng.randrange(-20, 900), 77, None])) for i in range(500)]
    s = spark.createDataFrame(symbols, "module string, name string, addr long, size long, kind int")
    p = spark.createDataFrame(points, "row_id long, module string, elf_va long")
    for span in (16, 1 << 22):
        out = joins.symbol_lookup(p, s, span=span).collect()
        assert len(out) == len(points)
        for r in out:
            own = [x[1:] for x in symbols if x[0] == r.module]
            assert (r.symbol, r.symbol_offset, r.symbol_contains) == (brute_symbol(own, r.elf_va) if own and r.elf_va is not None else (None, None, False)), r
    assert joins.symbol_lookup(p.limit(0), s).count() == 0


def test_broken_files_are_set_aside(spark, tmp_path):
    rows = {"a": ['{"event": "address"}', '{"event": "instruction_range", "instruction_count": 3}'], "b": ['{"event": "address"}', "{broken"], "c": ['{"event": "flow_gap"}', "", '{"event": "instruction_range", "instruction_count": 4}']}
    (tmp_path / "in").mkdir()
    for name, lines in rows.items():
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines))
    done = batch.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [(r.file[-7:], r.line_no, r.reason) for r in done.quarantined.collect()] == [("b.jsonl", 2, "malformed: {broken")]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.file[-7:], r.event_index, r.event) for r in out.collect()) == [("a.jsonl", 1, "address"), ("a.jsonl", 2, "instruction_range"), ("c.jsonl", 1, "flow_gap"), ("c.jsonl", 3, "instruction_range")]
    assert done.totals == {"events": 4, "instruction_range": 2, "address": 1, "flow_gap": 1, "exception": 0, "instructions": 7}
    table = spark.createDataFrame([(10, "b"), (9, None), (10, "a")], "n int, s string")
    batch.write_sorted_csv(table, str(tmp_path / "csv"))
    lines = [x for f in sorted((tmp_path / "csv").glob("part-*")) for x in f.read_text().splitlines() if x != "n,s"]
    assert lines == ["10,a", "10,b", "9,"]


def test_function_graphs(spark):
    """Bodies of two ranges, a call, a jump out, a jump to a hole, and a function that failed."""
    frame = spark.createDataFrame
    functions = frame([("f",), ("g",), ("h",), ("x",)], "function string")
    bodies = frame([("f", 0, 8), ("f", 8, 16), ("f", 100, 120), ("g", 200, 220), ("h", 300, 310), ("x", 400, 410)], "function string, start long, stop long")
    blocks = frame([("f", 0, 8), ("f", 8, 16), ("f", 100, 108), ("g", 200, 204), ("h", 300, 310), ("x", 400, 410)], "function string, block long, block_stop long")
    refs = [("f", 0, 8, False, "fallthrough"), ("f", 8, 104, False, "direct_jump"), ("f", 8, 104, False, "direct_jump"), ("f", 8, 0, True, "direct_call"), ("f", 100, 200, False, "direct_jump"), ("g", 200, 210, False, "direct_jump"), ("x", 400, 400, False, "direct_jump")]
    failures = frame([("h", "collect_edges", 300, "E", "m"), ("x", "collect_blocks", None, "E", "m")], "function string, phase string, block long, error_type string, message string")
    got = cfg.function_graphs(functions, bodies, blocks, frame(refs, "function string, src_block long, dst_address long, call boolean, type string"), failures)
    assert {tuple(r) for r in got.edges.collect()} == {("f", 0, 8, "fallthrough"), ("f", 8, 100, "direct_jump")}
    assert {tuple(r) for r in got.states.collect()} == {("f", "OK", 0), ("g", "PARTIAL", 1), ("h", "PARTIAL", 1), ("x", "FAILED", 1)}
    assert {(r.function, r.phase, r.block) for r in got.errors.collect()} == {("g", "resolve_destination_block", 200), ("h", "collect_edges", 300), ("x", "collect_blocks", None)}
    assert {r.function for r in got.blocks.collect()} == {"f", "g", "h"}
