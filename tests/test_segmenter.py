"""The cases of the fixtures, as event streams."""

from pyspark.sql import types as T

from hoptrail.operators.segmenter import segment_events
from hoptrail.sources.traces import EVENT

SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("event_index", T.LongType()), *EVENT.fields])


def rng(start, end, kind, next_pc=None, **more):
    return {"event": "instruction_range", "module": "main", "atom": "E", "runtime_start": hex(start), "runtime_end": hex(end), "elf_start": hex(start - 0x1000), "elf_end": hex(end - 0x1000), "start_symbol": f"f+{start:#x}", "end_symbol": f"f+{end:#x}", "instruction_count": 1, "waypoint": {"kind": kind, "asm": None, "taken": True}, "next_pc": hex(next_pc) if next_pc is not None else None} | more


CASES = {
    "a": [rng(0x1000, 0x1000, "return", status="target_unresolved"), {"event": "flow_gap", "reason": "lost"}, rng(0x2000, 0x2004, "direct_branch", 0x3000)],
    "b": [rng(0x1000, 0x1000, "return", 0x1100, target_source="software_return_stack", confidence="speculative"), rng(0x2000, 0x2000, "direct_branch", 0x2100)],
    "c": [rng(0x1000, 0x1000, "return", 0x2000, target_source="software_return_stack", confidence="speculative"), rng(0x2000, 0x2000, "direct_branch", 0x2100, path_confidence="speculative")],
    "d": [rng(0x1000, 0x1000, "return", 0x2000, target_source="software_return_stack", confidence="speculative"), {"event": "address", "address": "0x2000", "module": "main"}, rng(0x2000, 0x2000, "direct_branch", 0x2100)],
    "e": [rng(0x1000, 0x1000, "indirect_call", 0x6340, status="target_resolved"), rng(0x6340, 0x6340, "direct_branch", 0x6440, module="libc", start_symbol=None, end_symbol=None, elf_start="0x340", elf_end="0x340")],
    "f": [{"event": "address", "address": "0x51230abc", "reason": "no-configured-elf", "map": "/usr/lib/libzeta.so", "map_file_offset": "0x1abc"}],
}


def frame(spark, cases):
    rows = []
    for name, events in cases.items():
        for i, e in enumerate(events):
            row = {f.name: None for f in SCHEMA.fields} | e | {"file": name, "event_index": i}
            rows.append(tuple(row[f.name] for f in SCHEMA.fields))
    return spark.createDataFrame(rows, SCHEMA)


def test_evidence_cases(spark):
    out = {r.file: r for r in segment_events(frame(spark, CASES)).collect()}
    assert set(out) == set(CASES)
    a = out["a"].tokens
    assert [t.kind for t in a] == ["return", "flow_gap", "direct_branch"]
    assert not a[0].target_valid and a[0].dst_function == "<UNKNOWN_TARGET>"
    assert "lost" in a[1].reason.split(";") and a[2].continuity == "after_gap"
    b = out["b"].tokens
    assert b[0].confidence == "conflict" and b[0].return_stack_match is False
    assert (b[1].expected_pc, b[1].observed_pc) == ("0x1100", "0x2000")
    c = out["c"].tokens
    assert c[0].control_valid and not c[0].target_valid and not c[1].control_valid and not c[1].target_valid
    d = out["d"].tokens
    assert d[0].confidence == "confirmed" and d[0].target_valid and d[0].return_stack_match is True
    e = out["e"].tokens
    assert len(e) == 2 and (e[0].dst_module, e[0].dst_function, e[0].dst_offset) == ("libc", "<elf>", "0x340")
    f = out["f"].tokens
    assert len(f) == 1 and (f[0].module, f[0].function, f[0].function_offset) == ("libzeta.so", "<opaque>", "0x1abc")


def test_strict_drops_and_breaks_number_segments(spark):
    assert segment_events(frame(spark, {"g": CASES["a"][:1]}), policy="strict").count() == 0
    two = [rng(0x1000, 0x1000, "direct_branch", 0x2000), {"event": "exception"}, rng(0x2000, 0x2000, "direct_branch", 0x3000), rng(0x3000, 0x3000, "direct_branch", 0x4000)]
    got = segment_events(frame(spark, {"h": two}), min_edges=2).collect()
    assert [(r.segment_id, r.length, r.break_reason) for r in got] == [(1, 2, "file_end")]


def one(spark, events, **how):
    return segment_events(frame(spark, {"x": events}), **how).orderBy("segment_id").collect()


def test_strict_closes_where_the_target_is_missing(spark):
    events = [rng(0x5000, 0x5000, "direct_branch", 0x5100), rng(0x5100, 0x5100, "direct_branch"), rng(0x5200, 0x5200, "direct_branch", 0x5300), rng(0x5300, 0x5300, "direct_branch", 0x5400)]
    got = one(spark, events, policy="strict")
    assert [(r.segment_id, r.length, r.break_reason) for r in got] == [(0, 1, "missing_prev_next_pc"), (1, 2, "file_end")]


def test_indirect_branch_without_source_is_unresolved(spark):
    token = one(spark, [rng(0x5000, 0x5000, "indirect_branch", 0x5100)])[0].tokens[0]
    assert (token.target_source, token.confidence, token.target_valid) == ("unknown", "unresolved", False)
    hinted = one(spark, [rng(0x5000, 0x5000, "indirect_branch", 0x5100), rng(0x5100, 0x5100, "direct_branch", 0x5200)])[0].tokens
    assert [(t.target_source, t.confidence, t.target_valid) for t in hinted] == [("next_range", "confirmed", True), ("static", "exact", True)]


def test_returns_are_confirmed_or_rejected_by_addresses(spark):
    ret = rng(0x5000, 0x5000, "return", 0x5100, target_source="software_return_stack")
    at = lambda x: {"event": "address", "address": hex(x), "module": "main"}
    yes = one(spark, [ret, at(0x5100), rng(0x5100, 0x5100, "direct_branch", 0x5200)])[0].tokens
    assert yes[0].confidence == "confirmed" and yes[0].target_valid and yes[0].return_stack_match is True
    no = one(spark, [ret, at(0x6100)])[0].tokens
    assert (no[0].confidence, no[0].target_valid, no[0].return_stack_match) == ("conflict", False, False)
    assert (no[1].kind, no[1].reason, no[1].expected_pc, no[1].observed_pc) == ("flow_gap", "address_anchor_mismatch", "0x5100", "0x6100")


def test_ranges_without_elf_addresses_break(spark):
    good = rng(0x5000, 0x5000, "direct_branch", 0x5100)
    for field, reason in (("elf_start", "range_missing_start"), ("elf_end", "range_missing_end")):
        got = one(spark, [good, rng(0x5100, 0x5100, "direct_branch", 0x5200, **{field: None})])
        assert [(r.length, r.break_reason) for r in got] == [(1, reason)]


def test_context_modules_and_symbols(spark):
    inner = {"context_id": "7", "vmid": None, "el": "EL1", "security": None, "isa": None}
    got = one(spark, [rng(0x5000, 0x5000, "direct_branch", 0x5100), rng(0x5100, 0x5100, "direct_branch", 0x5200, context=inner)])
    assert [(r.length, r.break_reason) for r in got] == [(1, "context_change"), (1, "file_end")]
    learned = [{"event": "header", "modules": ["only"]}, {"event": "address", "address": "0x5000", "elf_addr": "0x4000", "module": "lib", "symbol": "g+0x8"}, rng(0x5000, 0x5000, "direct_branch", 0x5100, module=None, start_symbol=None, end_symbol=None)]
    token = one(spark, learned)[0].tokens[0]
    assert (token.module, token.function, token.function_offset) == ("lib", "g", "0x8")
    first = one(spark, [learned[0], rng(0x5000, 0x5000, "direct_branch", 0x5100, module=None)])[0].tokens[0]
    assert first.module == "only"


def test_break_reasons(spark):
    good = rng(0x5000, 0x5000, "direct_branch", 0x5100)
    for event, reason in (({"event": "trace_control", "kind": "trace_on", "reason": "r"}, "trace_control:trace_on"), ({"event": "discontinuity"}, "discontinuity:discontinuity"), ({"event": "exception"}, "exception"), ({"event": "trace_stream", "trace_id": "0x10"}, "trace_stream_change")):
        assert one(spark, [good, event])[0].break_reason == reason
    assert one(spark, [good, {"event": "trace_control", "kind": "conditional_flush"}])[0].break_reason == "file_end"
    assert one(spark, [good, {"event": "flow_gap", "reason": "lost"}], policy="strict")[0].break_reason == "flow_gap:lost"


def test_forced_conflicts_say_why_and_elf_va_counts(spark):
    """The edge before a mismatch has its reason; a range may give elf_va in place of elf_start."""
    plain = {"elf_start": None, "elf_va": "0x100"}
    rows = [
        rng(0x4100, 0x4108, "return", 0x4200, **plain),
        rng(0x4300, 0x4308, "return", 0x4400),
        rng(0x4350, 0x4358, "return", status="conflict", **plain),
        rng(0x4100, 0x4108, "return", 0x4500, target_source="software_return_stack", confidence="speculative", **plain),
        {"event": "address", "runtime_addr": "0x4600", "module": "main"},
    ]
    df = spark.createDataFrame([{"file": "f", "event_index": i} | r for i, r in enumerate(rows)], SCHEMA)
    tokens = [t for r in segment_events(df).orderBy("segment_id").collect() for t in r.tokens]
    edges = [(t.confidence, t.reason) for t in tokens if t.kind == "return"]
    assert edges == [("conflict", "pc_mismatch"), ("conflict", "range_before_partial_mismatch"), ("unresolved", None), ("conflict", "address_anchor_mismatch")]
