"""Reports, pruning and batches against brute force, row by row."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hoptrail.functions import control, text
from hoptrail.operators import joins, model, report, resolver

FLAGS = report.FLAGS


def walk(rows, threshold, size, least, write_all, partial):
    """(stream, row, seq, event, low_count, start_row) of one report, a row at a time."""
    out, window, last = [], [], None
    for s, row, p, c, tv, cv, gv in sorted(rows):
        if last is None or last[0] != s or row != last[1] + 1 or not tv:
            window = []
        last = (s, row)
        if not tv or not cv:
            window = []
            out.append((s, row, 0, "unscored_discontinuous_transition" if not tv else "unscored_speculative_path", 0, None))
            continue
        score = p * c**0.2 if gv else c
        window = [*window, (row, score < threshold)][-size:]
        low = sum(x for _, x in window)
        if write_all or score < threshold:
            out.append((s, row, 0, "score" if write_all else "low_token", low, None))
        if low >= least and (partial or len(window) >= size):
            out.append((s, row, 1, "window_alarm", low, window[0][0]))
    return out


@pytest.mark.parametrize("write_all,partial", [(False, False), (True, True)])
def test_reports(spark, tmp_path, write_all, partial):
    rng = random.Random(3)
    rows = [(s, i, rng.random(), rng.random(), rng.random() > 0.03, rng.random() > 0.03, rng.random() > 0.2) for s in range(3) for i in range(300) if rng.random() > 0.02]
    df = spark.createDataFrame(rows, "stream long, row long, dst_prob double, ctrl_prob double, transition_valid boolean, control_valid boolean, target_valid boolean")
    windowed = report.windows_of(df, ["stream"], "row", 0.3, 5, block=16)
    records = report.report(windowed, ["stream"], "row", 5, 3, write_all, partial)
    want = walk(rows, 0.3, 5, 3, write_all, partial)
    assert sorted((r.stream, r.row, r.seq, r.event, r.low_count, r.start_row) for r in records.collect()) == sorted(want, key=lambda x: x[:3])
    total = report.summary(windowed, 5, 3, partial).first()
    assert (total.total_samples, total.alarm_windows) == (len(rows), sum(x[3] == "window_alarm" for x in want))
    report.write_report(records, str(tmp_path / "out"), ["stream"], "row")
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x["stream"], x["row"], x["seq"]) for x in lines] == [x[:3] for x in want]
    assert report.report(report.windows_of(df.limit(0), ["stream"], "row", 0.3, 5), ["stream"], "row", 5, 3).count() == 0


def test_masks_stay(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(400)]
    df = spark.createDataFrame([(i, "a" if i < 100 else "b", v) for i, v in enumerate(values)], "i long, tensor string, w double")
    grown = lambda d, step: d.withColumn("w", F.col("w") + F.when(F.col("i") % 3 == 0, 0.5).otherwise(0.0))
    out, stats = model.prune(df, "w", [0.0, 0.3, 0.75], grown)
    now, keep = list(values), [True] * len(values)
    for step, share in enumerate((0.0, 0.3, 0.75)):
        if step:
            now = [(v + (0.5 if i % 3 == 0 else 0)) if keep[i] else 0.0 for i, v in enumerate(now)]
        k = int(len(now) * share)
        cut = sorted(map(abs, now))[k - 1] if k else -1
        keep = [abs(v) > cut for v in now]
        now = [v if q else 0.0 for v, q in zip(now, keep)]
        r = stats.filter(F.col("step") == step).first()
        assert (r.zeros, r.parameters) == (keep.count(False), len(now))
    assert {r.i: r.w for r in out.collect()} == pytest.approx(dict(enumerate(now)))
    r = model.sparsity_stats(out, "w").first()
    assert (r.tensors, r.parameters, r.zero_parameters) == (2, 400, sum(v == 0 for v in now))
    tensors = spark.createDataFrame([("Embed/table", [4, 4], "float32"), ("dense/kernel", [4, 4], "float16"), ("dense/bias", [4], "float32"), ("ids", [2, 2], "int32")], "name string, shape array<int>, dtype string")
    assert [r.name for r in model.prunable(tensors, ("embed",)).collect()] == ["dense/kernel"]


@pytest.mark.parametrize("n", [0, 31, 100, 250])
def test_full_batches(spark, n):
    got = sorted((r.piece_no, r.place, r.id) for r in model.full_batches(spark.range(n), ["id"], 50, 16, 60).collect())
    want, pieces = [], 0
    for b in range(0, n, 50):
        own = list(range(b, min(b + 50, n)))
        for a in range(0, len(own), 16):
            if a + 16 > len(own) or pieces * 16 >= 60:
                break
            want += [(pieces, i, x) for i, x in enumerate(own[a : a + 16])]
            pieces += 1
    assert got == want


def test_bodies_of_several_ranges(spark):
    rng = random.Random(6)
    bodies = [(f, a := rng.randrange(300), a + rng.randint(0, 20)) for f in range(12) for _ in range(3)]
    df = spark.createDataFrame(bodies, "func long, a long, b long")
    merged = {(r.func, r.a, r.b) for r in joins.merged_ranges(df, ["func"], "a", "b").collect()}
    places = lambda rs: {(f, x) for f, a, b in rs for x in range(a, b)}
    assert places(merged) == places(bodies) and not any(f == g and b == c for f, _, b in merged for g, c, _ in merged)
    points = spark.createDataFrame([(x,) for x in range(330)], "x long")
    for r in joins.containing(points, df, ["x"], "x", "func", "a", "b").collect():
        assert r.func == min((f for f, a, b in bodies if a <= r.x < b), default=None)


def test_resolved_addresses_get_symbol_section_and_bytes(spark):
    rows = [(1, "m", "e", 0x10, None), (2, "m", "e", 0x18, None), (3, None, None, None, "address-not-in-maps"), (4, "m", "e", 0x200, None)]
    resolved = spark.createDataFrame(rows, "row_id long, module string, elf string, elf_va long, reason string")
    symbols = spark.createDataFrame([("e", "f", 0x10, 8, 2), ("e", "g", 0x14, 0, 2)], "elf string, name string, addr long, size long, kind int")
    sections = spark.createDataFrame([("e", ".text", 0x0, 0x40)], "elf string, name string, addr long, size long")
    words = spark.createDataFrame([("e", 0x10, 7)], "elf string, va long, word long")
    out = {r.row_id: r for r in resolver.described(resolved, symbols, sections, words).collect()}
    assert [(out[i].symbol, out[i].symbol_offset, out[i].symbol_contains, out[i].section, out[i].word, out[i].reason) for i in (1, 2, 3, 4)] == [
        ("f", 0, True, ".text", 7, None),
        ("g", 4, False, ".text", None, "elf-bytes-unavailable"),
        (None, None, False, None, None, "address-not-in-maps"),
        ("g", 0x1EC, False, None, None, "elf-bytes-unavailable"),
    ]


def test_scores_and_taken(spark):
    r = spark.sql("SELECT 0.5D AS d, 0.25D AS c, true AS t").select(*[v.alias(k) for k, v in control.score("dst", F.col("d"), F.col("c"), F.col("t"), F.col("t"), ~F.col("t")).items()]).first()
    assert tuple(r) == (0.25, "ctrl_only_invalid_target")
    cases = spark.createDataFrame([(None, "conditional_branch", "N"), (True, "conditional_branch", "N"), (None, "return", None), (None, "normal", None)], "x boolean, k string, a string")
    assert [r[0] for r in cases.select(control.taken(F.col("x"), F.col("k"), F.col("a"))).collect()] == [False, True, True, None]


def test_texts(spark):
    rows = [("f+0x3", "g", 1, "b x", "b", "x", None, "lib/m.so", "/a/lib.so.1"), ("", "g", 17, None, "ret", None, "n", None, None), (None, "g", None, "", "", "", None, None, "[heap]"), (None, None, 4, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, n string, o long, a string, m string, p string, name string, elf string, mapped string")
    col, none = F.col, F.lit(None).cast("string")
    out = df.select(text.symbol_of(col("s"), col("n"), col("o")), text.waypoint_text(col("a"), col("m"), col("p")), text.module_name(col("name"), none, col("elf"), col("mapped"))).collect()
    assert [tuple(r) for r in out] == [("f+0x3", "b x", "m"), ("g+0x11", "ret", "n"), ("g+0x0", "<unknown>", None), (None, "<unknown>", None)]
