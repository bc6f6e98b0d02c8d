"""Addresses that many rows share are resolved once."""

from pyspark.sql import functions as F

from hoptrail.operators import resolver
from hoptrail.plans import catalogue


def test_shared_addresses_are_looked_up_once(spark, monkeypatch):
    maps_, rules, segments = catalogue.places(spark, "/root/testdata/sf0.001")
    points = spark.range(3_000).select(F.col("id").alias("row_id"), (F.col("id") % 6 * 400).alias("address"), (F.col("id") % 2).alias("context_id"), F.lit(None).cast("long").alias("vmid"), F.lit("EL1").alias("el"))
    seen, find = [], resolver.find_maps
    monkeypatch.setattr(resolver, "find_maps", lambda points, *rest: (seen.append(points.count()), find(points, *rest))[1])
    found = {r.row_id: tuple(r)[1:] for r in resolver.resolve(points, maps_, rules, segments).collect()}
    assert seen == [6] and len(found) == 3_000
    one = {r.row_id: tuple(r)[1:] for r in resolver.resolve(points.filter("row_id < 6"), maps_, rules, segments).collect()}
    assert all(found[i] == one[i % 6] for i in found) and any(x[5] for x in one.values())
