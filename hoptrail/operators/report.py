"""The report of scored steps: records, alarms after the record that raised them, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.control import score
from hoptrail.operators.scans import scan
from hoptrail.written import materialize

FLAGS = ["transition_valid", "control_valid", "target_valid"]


def windows_of(rows: DataFrame, by: list[str], row: str, threshold: float, size: int, mode: str = "combined", weight: float = 0.2, block: int | None = None) -> DataFrame:
    """Rows with their score and the window of the last ``size`` rows of a run that ends at each.

    ``rows`` has dst_prob, ctrl_prob and ``FLAGS``; ``row`` numbers a stream's rows. A run ends where rows
    aren't consecutive, where a transition isn't valid and at rows without a score. Low rows of a window are
    a difference of two running sums: that of its last row and that of the row before its first, found by number.
    """
    made = score(mode, F.col("dst_prob"), F.col("ctrl_prob"), *[F.col(c) for c in FLAGS], weight)
    own = rows.withColumns(made)
    low = (F.col("score_prob").isNotNull() & (F.col("score_prob") < threshold)).cast("bigint")
    own = scan(own, by, row, fills={"_last": F.struct(F.col(row).alias("row"), F.col("score_prob").isNull().alias("unscored"))}, block=block)
    # A row begins a run if the one before it isn't its neighbour or has no score.
    begins = F.col("_last").isNull() | (F.col("_last.row") != F.col(row) - 1) | F.col("_last.unscored") | ~F.col("transition_valid") | F.col("score_prob").isNull()
    own = own.withColumns({"_begins": begins, "_low": low}).drop("_last")
    own = scan(own, by, row, fills={"_start": F.when(F.col("_begins"), F.col(row))}, sums={"_lows": F.col("_low")}, block=block)
    start = F.greatest(F.when(F.col("_begins"), F.col(row)).otherwise(F.col("_start")), F.col(row) - (size - 1))
    own = materialize(own.withColumn("start_row", start), "windows")
    before = own.select(*by, F.col(row).alias("start_row"), F.col("_lows").alias("_before"))
    own = own.join(before, [*by, "start_row"], "left")
    scored = F.col("score_prob").isNotNull()
    return own.withColumns(
        {
            "is_low": F.when(scored, F.col("_low") == 1),
            "low_count": F.when(scored, F.col("_lows") + F.col("_low") - F.col("_before")).otherwise(F.lit(0)).cast("bigint"),
            "observed": F.when(scored, F.col(row) - F.col("start_row") + 1).otherwise(F.lit(0)).cast("bigint"),
        }
    ).drop("_begins", "_low", "_start", "_lows", "_before")


def report(windowed: DataFrame, by: list[str], row: str, size: int, least: int, write_all: bool = False, partial: bool = False) -> DataFrame:
    """Records of ``windows_of`` in the order (row, seq): every unscored row, low rows (or all of them), and alarms."""
    unscored = F.col("score_prob").isNull()
    record = F.when(unscored, F.col("score_basis")).otherwise(F.lit("score" if write_all else "low_token"))
    shown = windowed.filter(unscored | F.col("is_low") | F.lit(write_all))
    cols = lambda df, seq, event, start: df.select(*by, row, F.lit(seq).alias("seq"), event.alias("event"), "score_prob", "is_low", "low_count", start.cast("bigint").alias("start_row"), F.col("observed"))
    full = F.lit(True) if partial else F.col("observed") >= size
    alarms = windowed.filter(~unscored & full & (F.col("low_count") >= least))
    return cols(shown, 0, record, F.lit(None)).unionByName(cols(alarms, 1, F.lit("window_alarm"), F.col("start_row")))


def summary(windowed: DataFrame, size: int, least: int, partial: bool = False) -> DataFrame:
    """One row of totals."""
    scored = F.col("score_prob").isNotNull()
    full = F.lit(True) if partial else F.col("observed") >= size
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = windowed.agg(
        F.count("*").alias("total_samples"),
        n(scored).alias("scored_samples"),
        n(~scored).alias("unscored_samples"),
        n(~F.col("target_valid")).alias("invalid_target_samples"),
        n(~F.col("control_valid")).alias("invalid_control_samples"),
        n(F.col("is_low")).alias("low_samples"),
        n(scored & full & (F.col("low_count") >= least)).alias("alarm_windows"),
        F.coalesce(F.max("low_count"), F.lit(0)).alias("max_window_low_count"),
    )
    return out.withColumn("low_ratio", F.when(F.col("scored_samples") > 0, F.col("low_samples") / F.col("scored_samples")).otherwise(0.0))


def write_report(records: DataFrame, path: str, by: list[str], row: str) -> None:
    """One JSON object a line; the files, in the order of their names, have the records in order."""
    order = [*by, row, "seq"]
    ordered = records.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.to_json(F.struct(*records.columns)).alias("value")).write.text(path)
