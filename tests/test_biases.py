"""Distances that most pairs have, against counting all pairs."""

import random
from collections import Counter

import pytest

from hoptrail.operators import biases
from hoptrail.plans import catalogue


@pytest.mark.parametrize("few", [0, 1 << 22])
@pytest.mark.parametrize("spread", [300, 20_000])
def test_against_all_pairs(spark, monkeypatch, few, spread):
    rng = random.Random(spread)
    monkeypatch.setattr(biases, "FEW_PAIRS", few)
    monkeypatch.setattr(biases, "NARROW", 1 << 6)
    monkeypatch.setattr(biases, "WIDE", 1 << 9)
    left = [(rng.choice([1, 2, 3, None]), rng.randint(-spread, 3 * spread)) for _ in range(700)]
    right = [(rng.choice([1, 2, 4]), rng.randint(-spread // 9, spread // 9)) for _ in range(300)] + [(1, None)]
    want = Counter(a - b for k, a in left for j, b in right if k == j and b is not None)
    want = min(want.items(), key=lambda x: (-x[1], abs(x[0]), x[0]))
    xs, ys = spark.createDataFrame(left, "k long, a long"), spark.createDataFrame(right, "k long, b long")
    found = biases.most_covered(xs, ys, "k", "a", "b")
    assert [tuple(r) for r in found.collect()] == [want]
    assert biases.most_covered(xs, ys.limit(0), "k", "a", "b").count() == 0


def test_query_lists_no_pairs(spark, tmp_path):
    """30,000 parts and 20,000 suppliers of one place are 600 million pairs."""
    spark.range(30_000).selectExpr("id AS p_partkey", "7 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(20_000).selectExpr("id AS s_suppkey", "7 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = catalogue.queries()["q_bias_coverage"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(0, 10_000)]
    assert "p_size" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
