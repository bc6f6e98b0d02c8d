"""A written dataset is read back, and known to be whole or not."""

import tempfile

import pytest

from hoptrail.operators import dataset
from hoptrail.plans.catalogue import LIMITS, edge_segments

SF = "/root/testdata/sf0.001"


def test_write_read_ready(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/set"
    assert not dataset.ready(spark, path)
    data = dataset.build(edge_segments(spark, SF), ["user_id"], LIMITS)
    dataset.write(data, path, LIMITS)
    assert dataset.ready(spark, path)
    meta = dataset.read_meta(spark, path)
    rows = dataset.read_rows(spark, path).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(meta["total_rows"])) and meta["total_rows"] == meta["total_edges"] + meta["total_segments"]
    assert all(v == 0 for k, v in rows[0].asDict().items())
    for name in dataset.SHARED:
        v = dataset.read_vocabulary(spark, path, name)
        ids = sorted(r.id for r in v.collect())
        assert ids == list(range(meta["vocab_sizes"][name]))
        assert {r.token for r in v.filter("id < 2").collect()} == {"<PAD>", "<OOV>"}
    assert {r.token for r in dataset.read_vocabulary(spark, path, "node").filter("id IN (2, 3)").collect()} == set(dataset.RESERVED_NODES)
    spark.read.parquet(f"{path}/rows").limit(3).write.parquet(f"{path}/some")
    spark.createDataFrame([('{"format_version": 3}',)], "value string").write.mode("overwrite").text(f"{path}/meta")
    assert not dataset.ready(spark, path)


def test_empty_and_limits(spark):
    data = dataset.build(edge_segments(spark, SF).limit(0), ["user_id"])
    assert data.rows.count() == 0 and data.stats.first().edges == 0
    for bad in ({"module": 1}, {"function": -1}, {"node": 3}, {"count_clip": -1}, {"min_length": 0}):
        with pytest.raises(ValueError):
            dataset.Limits(**bad)


def test_counts_need_no_vocabularies(spark, monkeypatch):
    from hoptrail.operators import dataset
    from hoptrail.plans import catalogue

    def never(*_):
        raise AssertionError("made for counts")

    monkeypatch.setattr(dataset, "vocabularies", never)
    monkeypatch.setattr(dataset.windows, "row_ids", never)
    found = dataset.build(catalogue.edge_segments(spark, "/root/testdata/sf0.001"), ["user_id"], catalogue.LIMITS).stats.first()
    assert found.edges > found.examples > 0
