"""The layers against a machine that reads event by event, on random streams."""

import random

import pytest
from pyspark.sql import types as T
from segment_machine import machine_segments

from hoptrail.operators.segmenter import segment_events
from hoptrail.sources.traces import EVENT

SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("event_index", T.LongType()), *EVENT.fields])


def place(rng):
    return rng.choice([0x1000, 0x1004, 0x1008, 0x2000, None] + [0x1000, 0x1004] * 2)


def event(rng):
    pick = lambda *x: rng.choice(x)
    text = lambda v: None if v is None else pick(hex(v), str(v))
    context = {c: pick("1", "2", None) for c in ("context_id", "el")}
    kind = pick(*["instruction_range"] * 12, *["address"] * 5, "flow_gap", "flow_gap", "overflow", "trace_stream", "context", "header", "discontinuity", "trace_control", "exception", "other")
    row = {"event": kind, "reason": pick(None, None, None, "why")}
    if kind == "instruction_range":
        at, end = place(rng), place(rng)
        row = {"event": kind, "module": pick("m", "m", "n", None), "map": pick(None, None, "/lib/k", "[heap]"), "atom": pick("E", "N"), "runtime_start": text(at), "runtime_end": text(end), "next_pc": text(place(rng))}
        row |= {pick("elf_start", "elf_va"): text(at and at - 0x800), "elf_end": text(end and end - 0x800), "start_symbol": pick(None, "f+0x10", "g", "h~+4"), "end_symbol": pick(None, "f+0x14", "q+x"), "instruction_count": pick(1, None)}
        row |= {"status": pick(*[None] * 8, "resolved", "target_resolved", "conflict", "target_unknown", "target_unresolved", "weird"), "reason": pick(*[None] * 12, "address-not-in-maps", "odd"), "target_source": pick(None, None, "software_return_stack", "address_packet"), "confidence": pick(None, "speculative", "exact"), "path_confidence": pick(None, None, "speculative", "exact")}
        row |= {"waypoint": pick(None, {"kind": "return"}, {"kind": "direct_branch"}), "context": pick(*[None] * 5, context)}
    elif kind == "address":
        at = place(rng)
        row |= {pick("address", "runtime_addr"): text(at), pick("elf_addr", "elf_va"): text(at and at - 0x800), "module": pick("m", "n", None), "map": pick(None, "/lib/k"), "symbol": pick(None, "s+0x2"), "reason": pick(*[None] * 8, "no-configured-elf", "address-in-non-executable-map"), "map_file_offset": "0x77"}
    elif kind == "header":
        row |= {"modules": pick(["d"], ["d", ""], ["a", "b"], None)}
    elif kind == "context":
        row |= context
    elif kind == "trace_stream":
        row |= {"trace_id": pick("1", "2", None)}
    elif kind == "trace_control":
        row |= {"kind": pick("conditional_flush", "x", None)}
    elif kind == "flow_gap":
        row |= {"pc": pick(None, "0x9")}
    return row


def frame(spark, streams):
    names = [f.name for f in SCHEMA.fields]
    rows = [tuple(({"file": s, "event_index": i} | e).get(n) for n in names) for s, events in streams.items() for i, e in enumerate(events)]
    fixed = [tuple(T.Row(**{f.name: v.get(f.name) for f in SCHEMA[n].dataType.fields}) if isinstance(v, dict) else v for n, v in zip(names, r)) for r in rows]
    return spark.createDataFrame(fixed, SCHEMA)


@pytest.mark.parametrize("how", [{}, {"policy": "strict"}, {"target_modules": ("m", "k"), "min_edges": 2}])
def test_against_the_machine(spark, how):
    rng = random.Random(len(str(how)))
    streams = {f"s{k}": [event(rng) for _ in range(rng.randint(1, 80))] for k in range(60)}
    df = frame(spark, streams)
    key = lambda r: (r.file, r.segment_id)
    want = {key(r): r for r in machine_segments(df, **how).collect()}
    got = {key(r): r for r in segment_events(df, block=9, **how).collect()}
    assert want and sorted(got) == sorted(want)
    for k in want:
        a, b = got[k], want[k]
        for x, y in zip(a.tokens, b.tokens):
            assert x == y, (k, {n: (x[n], y[n]) for n in x.asDict() if x[n] != y[n]}, x.kind)
        assert (a.first_event, a.length, a.break_reason) == (b.first_event, b.length, b.break_reason), k


def test_empty(spark):
    assert segment_events(frame(spark, {})).count() == 0
