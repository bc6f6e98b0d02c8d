"""Running values over ordered streams that are cut into blocks, so that one long stream is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.written import materialize

#: Order values of a block.
BLOCK = 200_000


def scan(df: DataFrame, by: list[str], at: str, fills: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, block: int | None = None) -> DataFrame:
    """``df``, written, with what stands before each row of its stream: last values that aren't null, sums, least values.

    ``at`` is a whole number, unique in a stream. Each block is a window of its own, and
    what earlier blocks leave behind is a table of a row a block. Values of rows without
    anything before them are null, sums 0.
    """
    fills, sums, mins = fills or {}, sums or {}, mins or {}
    held = materialize(df.withColumn("_block", F.floor(F.col(at) / (block or BLOCK))), "scan")
    ends = held.groupBy(*by, "_block").agg(
        *[F.max_by(c, F.when(c.isNotNull(), F.col(at))).alias(f"_f_{k}") for k, c in fills.items()],
        *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()],
        *[F.min(c).alias(f"_m_{k}") for k, c in mins.items()],
    )
    past = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(c).alias(f"_b_{c}") for c in by],
        F.col("_block").alias("_b_block"),
        *[F.last(f"_f_{k}", ignorenulls=True).over(past).alias(f"_f_{k}") for k in fills],
        *[F.coalesce(F.sum(f"_s_{k}").over(past), F.lit(0)).alias(f"_s_{k}") for k in sums],
        *[F.min(f"_m_{k}").over(past).alias(f"_m_{k}") for k in mins],
    )
    inside = Window.partitionBy(*by, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumns(
        {k: F.last(c, ignorenulls=True).over(inside) for k, c in fills.items()}
        | {k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}
        | {k: F.min(c).over(inside) for k, c in mins.items()}
    )
    same = F.col("_block") == F.col("_b_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    out = local.join(carried, same)
    out = out.withColumns(
        {k: F.coalesce(F.col(k), F.col(f"_f_{k}")) for k in fills}
        | {k: F.col(k) + F.col(f"_s_{k}") for k in sums}
        | {k: F.least(F.col(k), F.col(f"_m_{k}")) for k in mins}
    )
    return out.drop(*[c for c in out.columns if c.startswith(("_f_", "_s_", "_m_", "_b_"))], "_block")


def running(df: DataFrame, by: list[str], at: str, fills: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None) -> DataFrame:
    """As ``scan`` for streams of no more rows than a block: one window, nothing written."""
    inside = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {k: F.last(c, ignorenulls=True).over(inside) for k, c in (fills or {}).items()}
        | {k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in (sums or {}).items()}
        | {k: F.min(c).over(inside) for k, c in (mins or {}).items()}
    )
