"""Mutual best matches against all pairs, with copies and ties."""

import random

import pytest
from pyspark.sql import functions as F

from hoptrail.operators import graph, joins, likeness
from hoptrail.plans import catalogue


def score(same, a, b):
    return graph.block_similarity(same["brand"], same["name"], F.lit(True), F.abs(a - b), F.least(a, b) / F.greatest(a, b), a == b)


@pytest.mark.parametrize("seed,copies", [(1, 0), (2, 40)])
def test_against_all_pairs(spark, seed, copies):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xyz"), rng.choice(["p", "q", None] + list("abcdefgh")), rng.choice("klmnopqr"), rng.choice([rng.randint(1, 9), rng.randint(1, 400)])) for i in range(500)]
    rows += [(len(rows) + i, *rng.choice(rows[:30])[1:]) for i in range(copies)]
    df = spark.createDataFrame(rows, "key long, type string, brand string, name string, size int")
    old, new = df.filter("key % 2 = 0"), df.filter("key % 2 = 1")
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    ratio = F.least("a.size", "b.size") / F.greatest("a.size", "b.size")
    s = graph.block_similarity(same("brand"), same("name"), same("type"), F.abs(F.col("a.size") - F.col("b.size")), ratio, same("size"))
    pairs = old.alias("a").join(new.alias("b"), same("type")).select(F.col("a.key").alias("o"), F.col("b.key").alias("n"), F.round(s, 9).alias("similarity"))
    want = sorted(tuple(r) for r in joins.mutual_best(pairs, 0.4, 0.02).collect())
    got = likeness.mutual_best(old, new, "key", ["type"], ["brand", "name"], "size", score, 0.4, 0.02)
    assert sorted((r.o, r.n, r.similarity) for r in got.collect()) == want and len(want) > 20


def test_query_never_pairs_rows(spark, tmp_path):
    """Parts of one kind: 40,000 rows would be 400 million pairs."""
    part = spark.range(40_000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    odd = spark.createDataFrame([(40_000, "one", "c", "u", 7), (40_001, "one", "c", "u", 8)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.unionByName(odd).write.parquet(str(tmp_path / "part.parquet"))
    found = catalogue.queries()["q_mutual_best"](spark, str(tmp_path))
    assert [(r.o, r.n) for r in found.collect()] == [(40_000, 40_001)]
    by_rows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "p_partkey" in x and "Join" in x]
    assert not by_rows
