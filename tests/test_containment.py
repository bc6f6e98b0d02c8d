"""Addresses inside many overlapping bodies."""

from pyspark.sql import functions as F

from hoptrail.operators import joins


def test_owners_are_combined_before_the_shuffle(spark):
    points = spark.range(4_000).select(F.col("id").alias("row"), F.when(F.col("id") % 50 < 49, F.col("id") % 7 * 10).alias("at"))
    bodies = spark.createDataFrame([(f, f, 60 - f % 3) for f in range(30)], "func long, a long, b long")
    found = joins.containing(points, bodies, ["row", "at"], "at", "func", "a", "b")
    want = {r: min((f for f in range(30) if r % 50 < 49 and f <= r % 7 * 10 < 60 - f % 3), default=None) for r in range(4_000)}
    assert {r.row: r.func for r in found.collect()} == want and found.count() == 4_000
    # Rows are never ranked among the bodies that hold them.
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert not any("row#" in x for x in windows)
