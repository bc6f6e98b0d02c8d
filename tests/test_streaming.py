"""The live alarms give what the batch operators give."""

import random
import tempfile
import time

from pyspark.sql import functions as F

from hoptrail.operators import packets, windows
from hoptrail.streaming.alarms import ROCKSDB, stream_alarms
from hoptrail.streaming.commits import live_queue

SCHEMA = "stream long, row long, score double, breaks boolean"


def test_stream_equals_batch(spark):
    rng = random.Random(1)
    rows = [(s, i, None if rng.random() < 0.05 else rng.random(), rng.random() < 0.05) for s in range(3) for i in range(60)]
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"{folder}/in")
    spark.conf.set(*ROCKSDB)
    try:
        live = stream_alarms(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), 0.4, 6, 3)
        query = live.writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(90)
        got = sorted(tuple(r) for r in spark.table("alarms").collect())
    finally:
        spark.conf.unset(ROCKSDB[0])
    runs = windows.scored_runs(df, "score", "row", ["stream"], ["row"], F.col("breaks"))
    batch = windows.alarms(windows.low_counts(runs, "score", 0.4, 6, ["stream"], ["row"], "row"), 6, 3)
    want = sorted(tuple(r) for r in batch.select("stream", "row", "low_count", "start_row").collect())
    assert want and got == want


def test_live_queue_equals_dispatch(spark):
    """Micro-batches of a few lines give what the whole stream gives at once."""
    rng = random.Random(2)
    words = ["ATOM - EN", "ATOM - E", "ATOM - NNE", "Commit - 1", "Commit - 3", "Cancel - 1", "Exception return", "Address - Instruction address 0x10, Instruction set AArch64", "other"]
    lines = [(s, i, rng.choice(words)) for s in ("a", "b") for i in range(40)]
    schema = "stream string, line_no long, line string"
    folder = tempfile.mkdtemp(prefix="spark-")
    for part in range(4):
        rows = [x for x in lines if x[1] // 10 == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    spark.conf.set(*ROCKSDB)
    try:
        live = live_queue(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        live.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(180)
        got = sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())))
    finally:
        spark.conf.unset(ROCKSDB[0])
    done = packets.dispatch(spark.createDataFrame(lines, schema), mode="commit").filter("action IN ('atom', 'commit', 'atoms_discarded') AND NOT (action = 'atoms_discarded' AND detail = 'end-of-trace')")
    want = sorted(map(str, (tuple(r) for r in done.select("stream", "line_no", "action", "idx", "atom", "count", "missing", "detail").collect())))
    assert got == want and any("atoms_discarded" in x for x in got)
