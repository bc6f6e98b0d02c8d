"""The comparison across components: no link is missed, and members of a template don't meet."""

import random

import numpy as np
from pyspark.sql import functions as F

from hoptrail.llm import near_dedup


def run(spark, docs, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    job = near_dedup.NearDedup(df, "doc_id", "text", 1, percent, 4, 48, 6, 5.0)
    sets = near_dedup.set_table(df, "doc_id", "text", 1).select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("label"), "shingles")
    return job, sets


def test_no_link_is_missed(spark):
    rng = random.Random(5)
    docs = []
    for family in range(30):
        base = [f"{family}w{j}" for j in range(rng.choice([1, 2, 5, 12, 33, 64, 90, 250]))] + [f"common{j}" for j in range(rng.choice([0, 6, 40]))]
        for _ in range(8):
            keep = [w for w in base if rng.random() > rng.choice([0, 0.05, 0.12])]
            docs.append((len(docs), " ".join(keep + [f"x{len(docs)}_{j}" for j in range(rng.choice([0, 0, 1, len(base) // 12]))])))
    sets = {d: set(t.split()) for d, t in docs}
    for percent in (80, 85):
        job, members = run(spark, docs, percent)
        got = {tuple(r) for r in job.across(members).collect()}
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert want and want <= got
        # A component's own pairs aren't visited, links of two components are found.
        half = members.withColumn("label", F.col("rep") % 2)
        assert {p for p in want if (p[0] + p[1]) % 2} <= {tuple(r) for r in job.across(half).collect()}


def test_template_members_do_not_meet(spark):
    """300 sets of 100 with 82 in common: 44,850 pairs at 0.7, none of them a link at 0.85."""
    rng = random.Random(6)
    docs = [(i, " ".join([f"t{j}" for j in range(82)] + [f"u{i}_{j}" for j in range(16 + rng.randint(0, 4))])) for i in range(300)]
    job, members = run(spark, docs, 85)
    assert (job.keyed(members)[1].agg(F.sum("visits")).first()[0] or 0) < 450


def test_size_classes_grow():
    c = near_dedup.size_class(np.arange(1, 5000))
    assert (np.diff(c) >= 0).all() and (np.diff(c) <= 1).all() and (c[:31] == np.arange(1, 32)).all()
