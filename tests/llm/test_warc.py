import gzip
import hashlib
import json
import tempfile
from collections import defaultdict

from hoptrail.llm import warc


def rows():
    big, other = "é" * 700, "x\r\n\r\nWARC/1.1\r\n" * 200
    return [(1, "http://a/ä b", big), (5, None, big), (3, "u", big), (3, "u", big), (7, "u", "s"), (8, "u", "s"), (9, "u", None), (10, "u", ""), (11, "u", other), (None, "u", other), (12, "u\r\nx", "y" * 300_000), (None, "n", "z" * 2000)] + [(100 + i, f"h{i}", "hot" * 400) for i in range(300)]


def expected(data):
    groups = defaultdict(list)
    for p, _, h in data:
        groups[h or ""].append(p)
    out = []
    for p, _, h in data:
        h = h or ""
        keep = max((x for x in groups[h] if x is not None), default=None) if len(h.encode()) >= 1000 else p
        out.append((p, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response" if keep == p else "revisit", None if keep == p else keep))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 50)
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", warc.F.lit(1))
    folder = tempfile.mkdtemp(prefix="spark-")
    got = warc.archive(df, f"file://{folder}").collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(data)
    assert sorted({r.url for r in got if r.page_id == 1}) == ["http://a/ä b"]
    assert {r.payload.decode() for r in got if r.page_id == 11} == {rows()[8][2]}


def test_members_are_gzip_of_their_own_and_indexed(spark):
    import glob

    folder = tempfile.mkdtemp(prefix="spark-")
    warc.archive(spark.createDataFrame(rows(), "page_id long, url string, html string"), folder).count()
    n = 0
    for idx in glob.glob(f"{folder}/members/*.idx"):
        data = open(idx.removesuffix(".idx") + ".warc.gz", "rb").read()
        for line in open(idx):
            e = json.loads(line)
            record = gzip.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert e["page"].encode() in record
            n += 1
    assert n == len(rows())
    assert not glob.glob(f"{folder}/members/*.tmp")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(df).count() == 0


def test_records_are_warc(spark):
    """A true target URI, an HTTP block, and lengths and digests that hold."""
    urls = ["http://a/b?c=d&e=%20f#g", "http://a/ä b", "u\r\nx: y", "http://a/100%", None]
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>" + "x" * 2000 * (i > 2)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = tempfile.mkdtemp(prefix="spark-")
    got = {r.page_id: r.url for r in warc.archive(df, folder).collect()}
    assert got == dict(enumerate(urls))
    import glob

    seen = {}
    for path in glob.glob(f"{folder}/members/*.warc.gz"):
        for head, block in warc.RecordStream(open(path, "rb")):
            h = warc.fields(head)
            http, _, payload = block.partition(b"\r\n\r\n")
            assert h["content-type"] == "application/http; msgtype=response" and http.startswith(b"HTTP/1.1 200 OK\r\n")
            assert int(h["content-length"]) == len(block) and h["warc-payload-digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
            seen[warc._page(h["warc-record-id"])] = h.get("warc-target-uri")
    assert seen == {0: urls[0], 1: "http://a/%C3%A4%20b", 2: "u%0D%0Ax:%20y", 3: "http://a/100%25", 4: None}
