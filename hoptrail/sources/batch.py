"""Batches of input files: the whole ones are written, broken ones are set aside with their reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.sources.traces import EVENT, read_lines
from hoptrail.written import materialize


@dataclass
class Batch:
    """What ``convert`` gives: (file, line_no, reason) of what is broken, and totals of what was written."""

    quarantined: DataFrame
    totals: dict[str, int]


def convert(spark: SparkSession, path: str, out: str, glob: str = "*.jsonl", recursive: bool = False) -> Batch:
    """Events of the files under ``path``, written as Parquet by file; a file with a broken line isn't written at all.

    Totals are observed while the rows are written: no second pass. Spark's commit makes the output whole or absent.
    """
    lines = read_lines(spark, path, glob, recursive)
    schema = T.StructType([*EVENT.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.withColumn("e", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    held = materialize(parsed.withColumn("broken", F.col("e").isNull() | F.col("e._broken").isNotNull() | ~F.col("line").startswith("{")), "parsed")
    bad = held.filter("broken").select("file", "line_no", F.concat(F.lit("malformed: "), F.left("line", F.lit(80))).alias("reason"))
    files = bad.select("file").distinct()
    good = held.join(files, "file", "left_anti").select("file", F.col("line_no").alias("event_index"), "e.*").drop("_broken")
    seen = Observation("batch")
    kinds = ("instruction_range", "address", "flow_gap", "exception")
    counted = good.observe(seen, F.count("*").alias("events"), *[F.count_if(F.col("event") == k).alias(k) for k in kinds], F.coalesce(F.sum("instruction_count"), F.lit(0)).alias("instructions"))
    counted.write.parquet(out)
    return Batch(bad, {k: int(v) for k, v in seen.get.items()})


def write_sorted_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each file; rows are in the order of their columns as texts, over the files in the order of their names."""
    order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).csv(path)
