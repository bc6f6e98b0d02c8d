"""Ordered operators over event streams, as window functions.

Each takes the columns that part the stream (``by``) and a total order within it
(``order``). Streams are the unit of parallelism; state never leaves a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.written import materialize


def ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def up_to_now(by: list[str], order: list[str]):
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(df: DataFrame, cols: dict[str, Column], by: list[str], order: list[str]) -> DataFrame:
    """New columns: the last value so far that isn't null."""
    w = up_to_now(by, order)
    return df.withColumns({name: F.last(col, ignorenulls=True).over(w) for name, col in cols.items()})


def changes(df: DataFrame, cols: list[str], by: list[str], order: list[str], out: str = "generation") -> DataFrame:
    """How often any of ``cols`` has changed so far; nulls equal nulls."""
    w = ordered(by, order)
    flag = F.lit(False)
    for c in cols:
        flag = flag | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    flagged = df.withColumn("_changed", (flag & (F.row_number().over(w) > 1)).cast("bigint"))
    return flagged.withColumn(out, F.sum("_changed").over(up_to_now(by, order))).drop("_changed")


def drop_repeats(df: DataFrame, col: str, by: list[str], order: list[str]) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    w = ordered(by, order)
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag(col).over(w)).filter((F.col("_n") == 1) | ~F.col(col).eqNullSafe(F.col("_p"))).drop("_n", "_p")


def segments(df: DataFrame, breaks: Column, by: list[str], order: list[str], out: str = "segment") -> DataFrame:
    """Number of breaks so far, the breaking row included."""
    return df.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("bigint")).withColumn(out, F.sum("_b").over(up_to_now(by, order))).drop("_b")


def segment_stats(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Length of each segment of at least ``least`` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("length")).filter(F.col("length") >= least)


def coalesce_gaps(df: DataFrame, is_gap: Column, reason: str, by: list[str], order: list[str]) -> DataFrame:
    """One row for each run of gap rows: first and last order value, rows, distinct reasons joined by ';'."""
    w = ordered(by, order)
    marked = df.withColumn("_gap", is_gap)
    marked = marked.withColumn("_new", (F.col("_gap") & ~F.coalesce(F.lag("_gap").over(w), F.lit(False))).cast("bigint"))
    runs = marked.withColumn("gap", F.sum("_new").over(up_to_now(by, order))).filter("_gap")
    key = order[-1]
    return runs.groupBy(*by, "gap").agg(F.min(key).alias("first_row"), F.max(key).alias("last_row"), F.count("*").alias("n_rows"), F.array_join(F.sort_array(F.collect_set(reason)), ";").alias("reasons"))


def continuity(df: DataFrame, is_gap: Column, by: list[str], order: list[str]) -> DataFrame:
    """gap, after_gap or continuous for each row."""
    w = ordered(by, order)
    after = F.coalesce(F.lag(is_gap).over(w), F.lit(False))
    return df.withColumn("continuity", F.when(is_gap, "gap").when(after, "after_gap").otherwise("continuous"))


def row_ids(df: DataFrame, segment: list[str], order: list[str]) -> DataFrame:
    """Row numbers of a flat layout with one padding row before each segment.

    Segments are dealt by ranges and numbered within each; only the ranges' totals
    are summed up in one task, so that no window spans the table or its segments.
    """
    sizes = df.groupBy(*segment).agg(F.count("*").alias("_n"))
    ranged = materialize(sizes.repartitionByRange(*segment).withColumn("_range", F.spark_partition_id()), "segments")
    ranges = ranged.groupBy("_range").agg(F.sum(F.col("_n") + 1).alias("_total"))
    before = ranges.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(F.col("_n") + 1).over(Window.partitionBy("_range").orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(*segment, (F.col("_before") + F.col("_inside")).alias("_start"))
    pos = F.row_number().over(Window.partitionBy(*segment).orderBy(*order)).cast("bigint")
    return df.withColumn("pos", pos - 1).join(starts, segment).withColumn("row_id", F.col("_start") + F.col("pos") + 1).drop("_start")


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Row numbers from 1 of the whole table in an order without ties, by ranges: only their totals are summed up in one task."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + place).cast("bigint")).drop("_range", "_before")


def history(df: DataFrame, col: str, size: int, by: list[str], order: list[str], out: str = "history", pad=0) -> DataFrame:
    """The ``size`` values before each row of its segment, padded on the left."""
    w = ordered(by, order).rowsBetween(-size, -1)
    seen = F.collect_list(F.coalesce(F.col(col), F.lit(pad))).over(w)
    return df.withColumn("_h", seen).withColumn(out, F.concat(F.array_repeat(F.lit(pad), size - F.size("_h")), F.col("_h"))).drop("_h")


def scored_runs(df: DataFrame, score: str, row: str, by: list[str], order: list[str], breaks: Column | None = None) -> DataFrame:
    """Scored rows with ``run``: it grows where rows aren't consecutive, where a row breaks, and after unscored rows."""
    w = ordered(by, order)
    unscored = F.col(score).isNull()
    reset = F.coalesce(F.lag(row).over(w) != F.col(row) - 1, F.lit(True)) | unscored | F.coalesce(F.lag(unscored).over(w), F.lit(False))
    if breaks is not None:
        reset = reset | F.coalesce(breaks, F.lit(False))
    flagged = df.withColumn("_r", reset.cast("bigint")).withColumn("run", F.sum("_r").over(up_to_now(by, order)))
    return flagged.filter(F.col(score).isNotNull()).drop("_r")


def low_counts(df: DataFrame, score: str, threshold: float, size: int, by: list[str], order: list[str], row: str) -> DataFrame:
    """is_low, low_count and observed rows of the last ``size`` rows of a run, and where that window starts."""
    w = Window.partitionBy(*by, "run").orderBy(*order).rowsBetween(-(size - 1), 0)
    low = F.col(score) < threshold
    return df.withColumns({"is_low": low, "low_count": F.sum(low.cast("bigint")).over(w), "observed": F.count("*").over(w), "start_row": F.first(row).over(w)})


def alarms(df: DataFrame, size: int, least_low: int, partial: bool = False) -> DataFrame:
    """Rows of ``low_counts`` whose window is full (or may be partial) and has enough low rows."""
    full = F.lit(True) if partial else F.col("observed") >= size
    return df.filter(full & (F.col("low_count") >= least_low))


def boundary_split(boundaries: DataFrame, col: str, raw: Column) -> DataFrame:
    """The boundary nearest to ``raw``, the larger one on ties."""
    return boundaries.withColumn("_d", F.abs(F.col(col) - raw)).orderBy(F.col("_d"), F.desc(col)).limit(1).select(col)
