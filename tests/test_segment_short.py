"""Streams no longer than a block, without addresses that name a place, are written once and never looked up."""

import random

import pytest
from pyspark.sql import functions as F
from segment_machine import machine_segments
from test_segment_layers import event, frame

from hoptrail.functions.literals import parse_int
from hoptrail.operators import scans, segment_layers
from hoptrail.operators.segmenter import segment_events


@pytest.mark.parametrize("policy", ["evidence", "strict"])
def test_short_streams_are_written_once(spark, monkeypatch, policy):
    written = []

    def seen(of):
        def materialize(df, name):
            written.append(name)
            return of(df, name)

        return materialize

    for module in (scans, segment_layers):
        monkeypatch.setattr(module, "materialize", seen(module.materialize))
    rng = random.Random(5)
    streams = {f"s{k}": [e for e in (event(rng) for _ in range(30)) if e["event"] != "address"] for k in range(20)}
    df = frame(spark, streams)
    short = sorted(segment_events(df, policy=policy).collect(), key=lambda r: (r.file, r.segment_id))
    assert short and written == ["events"]
    # Cut into blocks they give the same.
    assert sorted(segment_events(df, policy=policy, block=6).collect(), key=lambda r: (r.file, r.segment_id)) == short
    assert len(written) > 3


@pytest.mark.parametrize("named_gap", [False, True])
def test_strict_tokens_are_gathered_once(spark, named_gap):
    """The strict policy has no gaps to merge, whatever a range calls itself."""
    rng = random.Random(9)
    streams = {f"s{k}": [event(rng) for _ in range(40)] for k in range(20)}
    if named_gap:
        for events in streams.values():
            for e in events:
                if e["event"] == "instruction_range" and rng.random() < 0.4:
                    e["waypoint"] = {"kind": "flow_gap"}
    df = frame(spark, streams)
    found = segment_events(df, policy="strict")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    key = lambda r: (r.file, r.segment_id)
    got, want = (sorted(x.collect(), key=key) for x in (found, machine_segments(df, policy="strict")))
    assert want and [(key(r), r.first_event, r.length, r.break_reason, r.tokens) for r in got] == [(key(r), r.first_event, r.length, r.break_reason, r.tokens) for r in want]


def test_events_are_read_by_compiled_code(spark, monkeypatch):
    """The JVM compiles no method of more than 8,000 bytes; the step that reads all numbers of an event was longer."""
    written = []
    monkeypatch.setattr(segment_layers, "materialize", lambda df, name: written.append(df) or df)
    rng = random.Random(5)
    monkeypatch.setattr(segment_layers, "_segments", lambda e, *rest: e.withColumns({"segment_id": F.lit(0), "first_event": F.lit(0), "length": F.lit(1), "break_reason": F.lit(""), "x": F.array(F.struct(F.lit(0).alias("token")))}))
    segment_events(frame(spark, {"s": [event(rng) for _ in range(9)]}).repartition(2))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = written[0].select("*")._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution, "debug"), "package$")
        parts = getattr(debug, "MODULE$").codegenStringSeq(plan)
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8000


def test_parse_int_ways(spark):
    texts = {"42": 42, " 42 ": 42, "+42": 42, "-42": -42, "0x2a": 42, "-0X2A": -42, "0x7fffffffffffffff": 2**63 - 1, "0x8000000000000000": None, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "1" * 20: None, "": None, "4.2": None, "0x": None, "--1": None, "000000000000000000042": 42}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_int(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts
