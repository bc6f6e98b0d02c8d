"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoptrail.llm.scratch import materialize, release, shuffled


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node it reaches) for every node of links (a, b).

    Large-star and small-star steps take turns until nothing changes: each joins
    a node's neighbours to the smallest one, so a path of n links needs about
    log(n) rounds. Every round is written to the shared folder.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(shuffled(least), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("o")).filter(F.col("u") > F.col("o")).select("u", "v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        paired = large.join(shuffled(smallest), "u")
        small = paired.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(paired.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    release(links.sparkSession)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
