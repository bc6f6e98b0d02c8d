"""Sliding-window alarms over a live event stream, with the batch semantics.

Structured Streaming has no windows by count, so each stream keeps its last
``size`` scored rows in list state (``transformWithStateInPandas``, RocksDB).
Rows of a stream must arrive in order; batches are sorted by row before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hoptrail.written import new_path

OUTPUT = T.StructType([T.StructField("stream", T.LongType()), T.StructField("row", T.LongType()), T.StructField("low_count", T.LongType()), T.StructField("start_row", T.LongType())])


class AlarmWindow(StatefulProcessor):
    """Keeps (row, is_low) of the current run and emits a row for each alarm."""

    def __init__(self, threshold: float, size: int, least: int, partial: bool):
        self.threshold, self.size, self.least, self.partial = threshold, size, least, partial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "row long, low boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [(int(r), bool(low)) for r, low in self.window.get()]
        data = pd.concat(list(rows)).sort_values("row")
        out = []
        for row, score, breaks in zip(data["row"], data["score"], data["breaks"], strict=True):
            if pd.isna(score):
                held = []
                continue
            if breaks or (held and held[-1][0] != row - 1):
                held = []
            held = [*held, (int(row), bool(score < self.threshold))][-self.size :]
            low = sum(x for _, x in held)
            if low >= self.least and (self.partial or len(held) >= self.size):
                out.append((key[0], int(row), low, held[0][0]))
        if held:
            self.window.put(held)
        else:
            self.window.clear()
        yield pd.DataFrame(out, columns=["stream", "row", "low_count", "start_row"])

    def close(self) -> None:
        pass


def stream_alarms(scores: DataFrame, threshold: float, size: int, least: int, partial: bool = False) -> DataFrame:
    """Alarms of a streaming frame of stream, row, score (null: unscored) and breaks.

    The session needs RocksDB as its state store provider.
    """
    return scores.groupBy("stream").transformWithStateInPandas(AlarmWindow(threshold, size, least, partial), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(scores: DataFrame, threshold: float, size: int, least: int, partial: bool = False) -> DataFrame:
    """The alarms of rows (stream, row, score, breaks) that are written, streamed once, and read from the sink."""
    spark = scores.sparkSession
    paths = {name: new_path(spark, f"stream-{name}") for name in ("in", "out", "state")}
    scores.write.parquet(paths["in"])
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        live = stream_alarms(spark.readStream.schema(scores.schema).parquet(paths["in"]), threshold, size, least, partial)
        live.writeStream.format("parquet").option("path", paths["out"]).option("checkpointLocation", paths["state"]).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(ROCKSDB[0])
        else:
            spark.conf.set(ROCKSDB[0], before)
    return spark.read.schema(OUTPUT).parquet(paths["out"])
