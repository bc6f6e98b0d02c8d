"""Tables written to the shared checkpoint folder to cut lineage.

A written table survives lost executors, unlike a local checkpoint, and its
size is known, so that joins with it can be broadcast only when it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoptrail.written import materialize, new_path, shared_dir  # noqa: F401


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later read needs."""
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop broadcasts and shuffle files of finished steps: it acts once the driver has collected what refers to them."""
    spark.sparkContext._jvm.System.gc()


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose rows grow with the input, marked to be merged in joins.

    Spark would judge it by its file's bytes, whatever an explode makes of them, and broadcast through the driver millions of
    rows of ids that are a few bytes each on disk.
    """
    return df.hint("merge")


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, marked for broadcast when it has at most ``rows`` rows, and else to be merged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


#: Rows of a table that a join may broadcast, and the salts over which it deals a key otherwise.
LOOKUP_ROWS, SALTS = 200_000, 16


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined with a written table of distinct keys, whatever share of the rows a key has.

    A table of few rows is broadcast; a larger one has a row for each salt, over which the rows of a key are dealt.
    """
    if table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(table), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    every = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(shuffled(every), [*on, "_salt"], how).drop("_salt")


def bounded_batches(spark: SparkSession, rows: int = 1_000, megabytes: int = 16) -> None:
    """Lower the Arrow batches that Python tasks get to so many rows and bytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
