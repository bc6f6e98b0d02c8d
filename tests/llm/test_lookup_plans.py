"""Tables that grow with the input aren't broadcast, however few bytes their files have."""

from pyspark.sql import functions as F

from hoptrail.llm import near_dedup, scratch


def broadcasts(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in x]


def test_salted_keys_are_not_broadcast(spark, monkeypatch):
    """A key is a few bytes on disk; with a row for each salt, Spark took the table for a small one all the same."""
    rows = spark.range(400).select((F.col("id") % 50).alias("key"), "id")
    table = scratch.materialize(spark.range(20).select(F.col("id").alias("key")), "keys")
    want = [i for i in range(400) if i % 50 < 20]
    assert broadcasts(scratch.looked_up(rows, table, ["key"], "inner"))
    monkeypatch.setattr(scratch, "LOOKUP_ROWS", 10)
    out = scratch.looked_up(rows, table, ["key"], "inner")
    assert not broadcasts(out) and sorted(r.id for r in out.collect()) == want
    left = scratch.looked_up(rows, table.withColumn("hit", F.lit(1)), ["key"], "left")
    assert not broadcasts(left) and sorted(r.id for r in left.filter("hit = 1").collect()) == want and left.count() == 400
    few, many = scratch.broadcast_within(table, 20), scratch.broadcast_within(table, 19)
    assert broadcasts(rows.join(few, "key")) and not broadcasts(rows.join(many, "key"))


def test_near_dedup_broadcasts_ids_of_candidates_alone(spark, monkeypatch):
    written = {}
    real = near_dedup.materialize

    def noted(df, name):
        written[name] = broadcasts(df)
        return real(df, name)

    for module in ("near_dedup", "components"):
        monkeypatch.setattr(f"hoptrail.llm.{module}.materialize", noted)
    monkeypatch.setattr(scratch, "LOOKUP_ROWS", -1)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words, *(f"x{i % 7}{j}" for j in range(i % 5))])) for i in range(40)]
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=85)
    assert {r.component_id for r in out.collect()} == {0} and not broadcasts(out)
    assert len(written) > 15 and not any(written.values()), {k: v for k, v in written.items() if v}
