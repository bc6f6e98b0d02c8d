"""Column expressions over arrays that stay linear in the array's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed by one inner fold; longer arrays fold blocks of so many.
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Sums of the first 1, 2, ... n elements of an array of bigint.

    Appending to an array copies it, so one fold over n elements would copy n * n / 2;
    folds over blocks, then over block totals, keep that at ``BLOCK`` per element.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))

    def within(block: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"] + x).alias("out")), lambda a: a["out"])

    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<struct<base:bigint,part:array<bigint>>>").alias("out"))
    placed = F.aggregate(
        F.transform(blocks, within),
        start,
        lambda a, part: F.struct((a["s"] + F.coalesce(F.get(part, F.size(part) - 1), F.lit(0).cast("bigint"))).alias("s"), F.array_append(a["out"], F.struct(a["s"].alias("base"), part.alias("part"))).alias("out")),
        lambda a: a["out"],
    )
    return F.flatten(F.transform(placed, lambda p: F.transform(p["part"], lambda x: x + p["base"])))
