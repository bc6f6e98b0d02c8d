"""WARC archives: written by Spark, normalised record by record, read back by index.

Writing: one row is one record. Among records with equal payloads of at least
``min_bytes`` bytes the one with the largest page_id is the response and the
others revisit it. Spark's text writer makes each part file one gzip stream of
records (its line separator is the blank lines that end a WARC record), so
files appear by Spark's commit protocol and survive lost executors.

Normalising: each monolithic file is inflated once as a stream, every record is
written again as a gzip member of its own, and a sidecar lists offset, length
and page of each member. Files are written under a name of the attempt and
moved into place, so a repeated task leaves the same files.

Reading: sidecars give the members; each is inflated alone and parsed.

Defined cases: a null html is an empty payload; a null page_id is kept as null
and never preferred as response unless its whole group is null; rows that tie
on the largest page_id are all responses; a null url leaves the target header
out; rows equal in page_id and payload share a record id; an empty table gives no
records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoptrail.llm.scratch import new_path, remove

#: Records per written file: bounds a file, not the table.
FILE_RECORDS = 4_000
#: Spread of the rows of one payload over tasks.
SALTS = 32
_CRLF = b"\r\n"
#: The characters that URIs reserve.
_RESERVED = ":/?#[]@!$&'()*+,;="


def decide_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, bytes, digest and the page that a revisit refers to (else null)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    # Counts per payload need ids and digests alone; only payloads that occur again are joined, salted against hot ones.
    first = base.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("digest", "keeper")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")).alias("refers_to"))


def target_uri(url: F.Column) -> F.Column:
    """The URL with what a URI can't hold percent-encoded; escapes that it has already stay."""
    out = F.replace(F.regexp_replace(F.url_encode(url), "%25([0-9A-Fa-f]{2})", "%$1"), F.lit("+"), F.lit("%20"))
    for c in _RESERVED:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def _record(url, head: list) -> F.Column:
    target = target_uri(url)
    own = F.when(target != url, F.concat(F.lit("Page-URL: "), F.url_encode(url)))  # the exact one, where it is no URI
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *head, F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), target)), own)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` as gzip WARC files, one stream a file, under ``path``."""
    rows = decide_revisits(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    length = (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string")
    head = _record(
        F.col("url"),
        [
            F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(":"), F.col("digest"), F.lit(">")),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))),
            F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), length),
        ],
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    text = rows.select(F.concat(head, F.lit("\r\n\r\n"), http, body).alias("value"))
    text.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class RecordStream:
    """Records of a gzip file read once from front to back, in bounded pieces."""

    def __init__(self, source, piece: int = 1 << 20):
        self._source, self._piece, self._held = source, piece, bytearray()
        self._inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self._inflate.unconsumed_tail or (b"" if self._inflate.eof and self._inflate.unused_data else self._source.read(self._piece))
        if self._inflate.eof:  # another member follows
            data = self._inflate.unused_data + data
            self._inflate = zlib.decompressobj(31)
        if not data:
            return False
        self._held += self._inflate.decompress(data, 4 * self._piece)
        return True

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        while True:
            while (end := self._held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self._held.strip():
                        raise ValueError("a WARC header has no end")
                    return
            head = bytes(self._held[: end + 4])
            need = end + 4 + int(fields(head)["content-length"]) + 4
            while len(self._held) < need:
                if not self._more():
                    raise ValueError("a WARC record is cut off")
            yield head, bytes(self._held[end + 4 : need - 4])
            del self._held[:need]


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    pairs = (line.split(b": ", 1) for line in head.split(_CRLF)[1:] if line)
    return {k.decode().lower(): v.decode() for k, v in pairs}


def _page(urn: str | None) -> int | None:
    found = urn.removeprefix("<urn:page:").partition(":")[0] if urn else "none"
    return None if found == "none" else int(found)


def _filesystem(path: str):
    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names of the same store
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every file under ``source`` with one gzip member a record; returns the files and their record counts.

    ``target`` gets ``<file>.warc.gz`` and the sidecar ``<file>.idx`` of JSON lines
    (offset, length, page). The paths must be in a store that all executors reach.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # names alone

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                out_fs, folder = _filesystem(target)
                out_fs.create_dir(folder, recursive=True)
                stem = posixpath.join(folder, posixpath.basename(at).removesuffix(".gz").removesuffix(".txt"))
                trial = f"{stem}.{uuid.uuid4().hex}"
                index, offset, n = [], 0, 0
                with fs.open_input_stream(at, compression=None) as raw, out_fs.open_output_stream(f"{trial}.warc.tmp", compression=None) as out:
                    for head, payload in RecordStream(raw):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(head + payload + _CRLF * 2) + pack.flush()
                        out.write(member)
                        index.append(json.dumps({"offset": offset, "length": len(member), "page": fields(head)["warc-record-id"]}))
                        offset += len(member)
                        n += 1
                with out_fs.open_output_stream(f"{trial}.idx.tmp", compression=None) as out:
                    out.write("".join(f"{x}\n" for x in index).encode())
                out_fs.move(f"{trial}.warc.tmp", f"{stem}.warc.gz")
                out_fs.move(f"{trial}.idx.tmp", f"{stem}.idx")
                yield pa.RecordBatch.from_pydict({"archive": [f"{stem}.warc.gz"], "records": [n]})

    return files.mapInArrow(run, "archive string, records long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of normalised archives, by their sidecars: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                with fs.open_input_stream(at.removesuffix(".warc.gz") + ".idx", compression=None) as lines:
                    index = [json.loads(x) for x in lines.read().splitlines()]
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for entry in index:
                        file.seek(entry["offset"])
                        record = zlib.decompress(file.read(entry["length"]), 31)
                        end = record.index(b"\r\n\r\n") + 4
                        rows.append(_parsed(fields(record[:end]), record[end:-4]))
                        held += len(record)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def _parsed(head: dict[str, str], block: bytes) -> dict:
    """A row of a record's fields and block: an HTTP header and, in a response, the payload."""
    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    http, _, payload = block.partition(_CRLF * 2)
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    own = head.get("page-url")
    return {
        "page_id": _page(head["warc-record-id"]),
        "payload_bytes": int(fields(http)["content-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")),
        "url": urllib.parse.unquote_plus(own) if own is not None else head.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages``, normalise the archives and read them back."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    write_archives(pages, f"{folder}/monolithic", min_bytes)
    normalise(spark, f"{folder}/monolithic", f"{folder}/members").agg(F.sum("records")).collect()
    remove(spark, f"{folder}/monolithic")  # no later read needs it
    return read_archives(spark, f"{folder}/members")
