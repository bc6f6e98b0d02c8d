import hashlib
import random
from collections import Counter, defaultdict

import pytest

from hoptrail.llm import mixing, queries


def levels(sizes, weights, share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        now = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        above = {s: most * sizes[s] for s in now if now[s] > most * sizes[s]}
        if not above:
            return fixed | now
        fixed |= above


def brute(rows, weights=(5, 2, 1)):
    """doc_id to (source_size, target, taken), one document after the other in the order of the keys."""
    by = defaultdict(list)
    for d, source, size in rows:
        by[source].append((int(hashlib.md5(f"0:{d}".encode()).hexdigest()[:15], 16), d, size))
    order = sorted(by, key=lambda s: (s is None, s))
    sizes = {s: sum(x[2] for x in by[s]) for s in by}
    target = levels(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)})
    out = {}
    for s, docs in by.items():
        taken, left = Counter(), round(target[s])
        while left > 0 and sizes[s]:
            for _, d, size in sorted(docs):
                part = min(left, size)
                taken[d] += part
                left -= part
        out |= {d: (sizes[s], target[s], taken[d]) for _, d, _ in docs}
    return out


def check(out, want):
    assert len(out) == len(want)
    for r in out:
        size, target, taken = want[r.doc_id]
        assert (r.source_size, r.taken) == (size, taken)
        assert r.target == pytest.approx(target, rel=1e-12)
        assert r.taken <= 2 * r.size


@pytest.mark.parametrize("ranges", [1, 40])
def test_against_a_walk(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    rng = random.Random(ranges)
    names = [None, "", "b", "B", "é", "zz", "𝄞", "empty"]
    rows = [(i, s := rng.choice(names[:7] + ["b"] * 8), 0 if s == "empty" else rng.choice([0, 1, 5, 40, 3_000])) for i in range(400)] + [(400, "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").selectExpr("*", "1 as target", "doc_id as row", "'k' as key")
    mixed = mixing.mix(df, [5, 2, 1])
    assert mixed.columns == ["doc_id", "source", "size", "row", "key", "source_size", "target", "taken"]
    check(mixed.collect(), brute(rows))
    again = mixing.mix(df.repartition(5, "size"), [5, 2, 1]).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed.collect()))
    totals = {r.source: (r.s, r.t) for r in mixed.groupBy("source").agg({"taken": "sum", "target": "first"}).withColumnsRenamed({"sum(taken)": "s", "first(target)": "t"}).collect()}
    assert all(abs(s - t) <= 1 for s, t in totals.values())
    assert mixing.mix(df.limit(0), [5, 2, 1]).count() == 0


def test_given_weights_repeats_and_nulls(spark):
    rows = [(1, "a", 10), (1, "a", 10), (None, "a", None), (2, "b", -4), (3, "b", 100), (4, "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, w double")
    out = mixing.mix(df, weights, share=1.0).collect()
    assert len(out) == len(rows)
    assert {(r.source, r.target) for r in out} == {("a", 40.0), ("b", 87.0)}
    assert sum(r.taken for r in out if r.source == "a") == 40 and sum(r.taken for r in out if r.source == "b") == 87


def test_the_mixture_has_what_was_taken(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("abc"), " ".join(rng.choice(["x", "yé", "\nz", "\t"]) for _ in range(rng.randint(0, 30))) if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", mixing.word_count(mixing.F.col("text")))
    mixed = mixing.mix(df, [5, 2, 1])
    drawn = mixing.draw(mixed).withColumn("words", mixing.word_count(mixing.F.col("text"))).collect()
    got = Counter()
    texts = {d: t for d, _, t in rows}
    for r in drawn:
        got[r.doc_id] += r.words
        assert texts[r.doc_id].startswith(r.text) and r.epoch < 2
    assert got == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.op12_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", mixing.word_count(mixing.F.col("text")).alias("n")).collect()
    check(out, brute([tuple(r) for r in docs]))
