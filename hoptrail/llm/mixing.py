"""Mixing sources to target weights, in words or tokens.

``targets`` shares a total by weights; a target stops at ``most`` times its
source's size, and the excess is shared again by weight until none is above. The
level, what one unit of weight gets, only rises from round to round, so each
round is one aggregate of the table of sources, whose sums alone reach the driver.

``mix`` gives every document a random key, the hash of a seed and its id, and
sorts each source by it in ranges. Keys are spread evenly, so ranges of equal width
are as even as sampled ones, a hot source has as many ranges as its share asks
for, and a rerun has the same ones. Sizes are summed up within ranges and over
the ranges before them, and a source's order is cut where its budget, its
rounded target, is reached: the last document is taken in part. A budget beyond
the source's size takes every document as often as it holds the whole source and
begins it again in the same order.

Defined cases: null and negative sizes are 0; a null source is a source of its
own, the last one; a source of size 0 has the target 0; documents with equal ids
stand in the order of their size and other columns, and equal rows are
interchangeable; a null id is an id of its own; extra columns pass through
whatever their names, and result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.llm.scratch import looked_up, materialize
from hoptrail.operators.windows import numbered

#: Ranges of keys for each shuffle partition.
RANGES = 4
_KEY_SPACE = float(1 << 60)
_RESULTS = ["source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, source: str, weights: list[int], out: str = "weight") -> DataFrame:
    """``sources`` with weights dealt in the order of code points, null last, again and again."""
    dealt = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    return numbered(sources, [F.col(source).isNull(), F.col(source)], "_n").withColumn(out, dealt.cast("double")).drop("_n")


def targets(sources: DataFrame, size: str, weight: str, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sources``, a written table with a size and a weight above 0 each, with ``target``: ``share`` of all sizes by weight, at most ``most`` of its own."""
    if share > most:
        raise ValueError("no source may take so much")
    cap, own = F.col(size) * most, F.col(weight)
    whole, every = sources.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0.0))).first()
    total = share * float(whole)
    level, before = total / every if every else 0.0, None
    while level != before:
        above = own * F.lit(level) > cap
        taken, gone = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(above, own)), F.lit(0.0))).first()
        if gone == every:
            break
        level, before = (total - float(taken)) / (every - gone), level
    return sources.withColumn("target", F.least(cap.cast("double"), own * F.lit(level)))


def mix(docs: DataFrame, weights: DataFrame | list[int], size: str = "size", source: str = "source", doc_id: str = "doc_id", share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """``docs`` with source_size, ``target`` of its source, and ``taken``: how much of it the mix takes, repeats counted.

    ``weights`` is a table of (source, weight), or weights that are dealt to the sources in their order.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in _RESULTS]
    named = F.col(f"`{source}`").cast("string")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.struct(named.isNull().alias("none"), F.coalesce(named, F.lit("")).alias("name")).alias("source"),
        F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long").alias("key"),
    )
    held = materialize(rows, "sized")
    sized = materialize(held.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    name = F.when(~F.col("source.none"), F.col("source.name"))
    if isinstance(weights, list):
        weighed = cycled_weights(sized.withColumn("_name", name), "_name", weights)
    else:
        given = weights.select(F.col(weights.columns[0]).cast("string").alias("_given"), F.col(weights.columns[1]).cast("double").alias("weight"))
        weighed = sized.withColumn("_name", name).join(given, F.col("_name").eqNullSafe(F.col("_given")))
    shared = targets(materialize(weighed.select("source", "source_size", "rows", "weight"), "weighed"), "source_size", "weight", share, most)
    # Ranges of keys, as many as a source's share of the rows asks for.
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = held.count()
    budget, whole = F.round("target").cast("long"), F.col("source_size")
    plan = materialize(
        shared.select("source", "source_size", "target", F.ceil(F.col("rows") * ranges / F.lit(float(max(count, 1)))).alias("ranges"), budget.alias("budget"), F.when(whole > 0, F.floor(budget / whole)).otherwise(0).cast("long").alias("epochs")),
        "targets",
    )
    ranged = looked_up(held, plan, ["source"], "left").withColumn("range", F.least(F.floor(F.col("key") / F.lit(_KEY_SPACE) * F.col("ranges")), F.col("ranges") - 1))
    ranged = materialize(ranged, "ranged")
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(sums.select("source", "range", before.alias("before")), "starts")
    order = Window.partitionBy("source", "range").orderBy("key", F.col(f"row.`{doc_id}`"), "size", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = looked_up(inside, starts, ["source", "range"], "left")
    begun = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inside")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.least(begun, F.col("size")), F.lit(0))
    return placed.select(*[F.col("row")[c].alias(c) for c in own], "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def draw(mixed: DataFrame, size: str = "size", text: str = "text") -> DataFrame:
    """The mixture itself: a row for each time that a document is taken, with ``epoch`` and, where it is taken in part, its first words alone."""
    n, taken = F.col(f"`{size}`").cast("long"), F.col("taken")
    times = F.when((n > 0) & (taken > 0), F.ceil(taken / n)).otherwise(0).cast("int")
    rows = mixed.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    left = F.least(taken - F.col("epoch") * n, n).cast("int")
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return rows.withColumn(text, F.when(left < n, F.array_join(F.slice(words, F.lit(1), left), "")).otherwise(F.col(f"`{text}`")))
