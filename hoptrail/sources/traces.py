"""Readers of trace text, process maps, event and segment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.functions import text
from hoptrail.written import materialize

MAP_LINE = r"^([0-9a-fA-F]+)-([0-9a-fA-F]+)\s+([rwxsp-]{4})\s+([0-9a-fA-F]+)\s+(\S+)\s+(\d+)\s*(.*)$"
LOCATION = T.StructType([T.StructField(n, T.StringType()) for n in ("module", "runtime_addr", "elf_addr", "function", "function_offset")])
TOKEN = T.StructType(
    [
        T.StructField("entry", LOCATION),
        T.StructField("src_ctrl", T.StructType([*LOCATION.fields, T.StructField("asm", T.StringType())])),
        T.StructField("ctrl", T.StructType([T.StructField("kind", T.StringType()), T.StructField("atom", T.StringType())])),
        T.StructField("dst", LOCATION),
        T.StructField("instruction_count", T.StringType()),
        T.StructField("quality", T.MapType(T.StringType(), T.StringType())),
    ]
)
SEGMENT = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("recovery_policy", T.StringType()), T.StructField("segment_id", T.LongType()), T.StructField("context", T.MapType(T.StringType(), T.StringType())), T.StructField("length", T.IntegerType()), T.StructField("start", LOCATION), T.StructField("tokens", T.ArrayType(TOKEN)), T.StructField("break_reason", T.StringType())])
EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event", "module", "atom", "status", "reason", "runtime_start", "runtime_end", "elf_start", "elf_end", "start_symbol", "end_symbol", "next_pc", "target_source", "confidence", "path_confidence", "address", "runtime_addr", "elf_addr", "elf_va", "symbol", "map", "map_file_offset", "pc", "detail", "trace_id", "context_id", "vmid", "el", "security", "isa", "kind")]
    + [T.StructField("context", T.StructType([T.StructField(n, T.StringType()) for n in ("context_id", "vmid", "el", "security", "isa")])), T.StructField("modules", T.ArrayType(T.StringType()))]
    + [T.StructField("instruction_count", T.LongType()), T.StructField("waypoint", T.StructType([T.StructField("kind", T.StringType()), T.StructField("asm", T.StringType()), T.StructField("taken", T.BooleanType())]))]
)


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """file, line_no (from 1) and text of every line that isn't blank, stripped.

    A large file is read in many tasks: each split's lines keep their order by a running
    id, and a line's number is its place in its split after the lines of the splits
    before. Only the splits' sizes are gathered, one row each.
    """
    text_ = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path)
    held = materialize(text_.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value"), "lines")
    splits = held.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.join(splits.select("file", "split", "first", before.alias("before")), ["file", "split"])
    line = F.btrim("value", F.lit(" \t\r\n\f\x0b"))
    return placed.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), line.alias("line")).filter("line != ''")


def parse_maps(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings of a process map's lines, and the lines that aren't any."""
    part = lambda i: F.regexp_extract("line", MAP_LINE, i)
    number = lambda i: F.conv(part(i), 16, 10).try_cast("bigint")
    good = lines.filter(F.col("line").rlike(MAP_LINE))
    maps = good.select("line_no", number(1).alias("start"), number(2).alias("end"), part(3).alias("perms"), number(4).alias("pgoff"), part(5).alias("device"), part(6).cast("bigint").alias("inode"), F.nullif(F.trim(part(7)), F.lit("")).alias("path"))
    return maps, lines.filter(~F.col("line").rlike(MAP_LINE))


def packets(lines: DataFrame) -> DataFrame:
    """Lines with their packet kind and fields."""
    return lines.withColumn("kind", text.packet_kind(F.col("line"))).withColumns({f"p_{k}": v for k, v in text.packet_fields(F.col("line")).items()})


def read_events(spark: SparkSession, path: str, glob: str = "*.jsonl", recursive: bool = False) -> DataFrame:
    """Events with file and event_index; a malformed line fails the read."""
    lines = read_lines(spark, path, glob, recursive)
    checked = lines.withColumn("e", F.from_json("line", EVENT, {"mode": "FAILFAST"}))
    numbered = checked.select("file", F.col("line_no").alias("event_index"), "e.*")
    return numbered


def read_segments(spark: SparkSession, path: str, glob: str = "*.jsonl", recursive: bool = False) -> DataFrame:
    """Segments with their file; a line that is no object fails the read."""
    lines = read_lines(spark, path, glob, recursive)
    return lines.withColumn("s", F.from_json("line", SEGMENT, {"mode": "FAILFAST"})).select("file", "line_no", "s.*")


def write_json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One compact object a line, nulls left out."""
    own = [c for c in df.columns if c not in (by or [])]
    out = df.select(*(by or []), F.to_json(F.struct(*own)).alias("value"))
    (out.write.partitionBy(*by) if by else out.write).text(path)


def module_rules(spark: SparkSession, config: dict) -> DataFrame:
    """Module rules of a configuration: name, elf, load_bias, anchors, allowed ids and runtime ranges."""
    if not config.get("modules"):
        raise ValueError("the configuration needs a list of modules")
    rows = []
    for i, m in enumerate(config["modules"]):
        if not m.get("elf"):
            raise ValueError(f"module {i} has no elf")
        ranges = [tuple(int(str(x), 0) for x in r) for r in m.get("runtime_ranges") or []]
        if any(b <= a for a, b in ranges):
            raise ValueError(f"module {i} has an empty range")
        bias = m.get("load_bias")
        ids = lambda k, m=m: [int(str(x), 0) for x in m[k]] if m.get(k) else None
        rows.append((i, m.get("name") or m["elf"].rsplit("/", 1)[-1].rsplit(".", 1)[0], m["elf"], None if bias in (None, "auto") else int(str(bias), 0), m.get("anchor_maps") or [], ids("context_ids"), ids("vmids"), [str(x).upper() for x in m["els"]] if m.get("els") else None, ranges))
    return spark.createDataFrame(rows, "module_idx int, name string, elf string, load_bias long, anchors array<string>, context_ids array<long>, vmids array<long>, els array<string>, ranges array<struct<start:long,stop:long>>")
