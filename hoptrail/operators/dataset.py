"""Training tables from segments: raw edges, vocabularies, encoded rows, and what describes them.

An encoded table is flat: one padding row before each segment, then a row for each
edge, numbered by ``row_id``. All columns are ids, so a window over ``row_id`` never
needs the segments.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoptrail.functions import control
from hoptrail.functions.literals import GAP, UNKNOWN_TARGET, clean_value, parse_int
from hoptrail.operators import vocab, windows
from hoptrail.written import materialize

#: Fields of a row, the vocabularies they share, and the format's version.
INPUTS = ["src_module", "src_ctrl_func", "src_ctrl_off", "ctrl_type", "dst_module", "dst_func", "dst_off", "icount"]
FLAGS = ["target_valid", "control_valid", "transition_valid", "is_gap"]
SHARED = {"module": ["src_module", "dst_module"], "function": ["src_ctrl_func", "dst_func"], "offset": ["src_ctrl_off", "dst_off"], "node": ["dst_node"], "ctrl_type": ["ctrl_type"]}
RESERVED_NODES = (f"{UNKNOWN_TARGET}@0x0", f"{GAP}@0x0")
UNKNOWN_MODULE = "<UNKNOWN_MODULE>"
FORMAT_VERSION = 4
DOUBTFUL = ["speculative", "unresolved", "conflict"]


@dataclass(frozen=True)
class Limits:
    """Sizes of vocabularies with their two reserved ids (0: unlimited), the clip of instruction counts, the least edges of a segment."""

    module: int = 4_096
    function: int = 50_000
    offset: int = 65_536
    node: int = 200_000
    ctrl_type: int = 0
    count_clip: int = 255
    min_length: int = 1

    def __post_init__(self) -> None:
        for name in SHARED:
            if getattr(self, name) < 0 or getattr(self, name) == 1:
                raise ValueError(f"{name} must be 0 or at least 2")
        if 0 < self.node < vocab.FIRST_ID + len(RESERVED_NODES):
            raise ValueError("node is too small for its reserved tokens")
        if self.count_clip < 0 or self.min_length < 1:
            raise ValueError("count_clip must be at least 0 and min_length at least 1")


def raw_edges(segments: DataFrame, by: list[str]) -> DataFrame:
    """The tokens of segments (``by``, tokens as written) as rows with their raw fields and flags, in order of ``pos``."""
    t = segments.select(*by, F.posexplode("tokens").alias("pos", "t"))
    at = lambda side, name: clean_value(F.col("t")[side][name])
    quality = lambda name: F.col("t")["quality"][name]
    kind, atom, confidence = at("ctrl", "kind"), at("ctrl", "atom"), clean_value(quality("confidence"))
    flag = F.when(atom == "E", True).when(atom == "N", False)
    dst_module, dst_func, dst_off = F.coalesce(at("dst", "module"), F.lit(UNKNOWN_MODULE)), at("dst", "function"), at("dst", "function_offset")
    said = lambda name: F.when(quality(name).isin("true", "false"), quality(name) == "true")
    continuity = F.coalesce(clean_value(quality("continuity")), F.lit("continuous"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return t.select(
        *by,
        "pos",
        F.coalesce(at("src_ctrl", "module"), F.lit(UNKNOWN_MODULE)).alias("src_module"),
        at("src_ctrl", "function").alias("src_ctrl_func"),
        at("src_ctrl", "function_offset").alias("src_ctrl_off"),
        control.control_label(kind, flag, atom, confidence).alias("ctrl_type"),
        dst_module.alias("dst_module"),
        dst_func.alias("dst_func"),
        dst_off.alias("dst_off"),
        control.node_id(dst_module, dst_func, dst_off).alias("dst_node"),
        parse_int(F.col("t")["instruction_count"]).alias("icount_raw"),
        yes(F.coalesce(said("target_valid"), F.lit(True)) & dst_func.isNotNull() & dst_off.isNotNull()).alias("target_valid"),
        yes(F.coalesce(said("control_valid"), ~F.coalesce(clean_value(quality("path_confidence")) == "speculative", F.lit(False)))).alias("control_valid"),
        yes(continuity == "continuous").alias("transition_valid"),
        yes((clean_value(quality("status")) == "gap") | (kind == "flow_gap")).alias("is_gap"),
    )


def scan_stats(segments: DataFrame, edges: DataFrame, by: list[str], limits: Limits) -> DataFrame:
    """One row of counts: segments seen, kept and dropped, edges and examples, and doubtful ones among them."""
    long = F.coalesce(F.size("tokens"), F.lit(0)) >= limits.min_length
    kept = segments.agg(F.count("*").alias("segments_seen"), F.count_if(long).alias("segments_kept"), F.count_if(~long).alias("segments_dropped_short"))
    found = edges.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("pos") > 0).alias("examples"),
        F.count_if(F.col("target_valid") == 0).alias("invalid_target_edges"),
        F.count_if(F.col("control_valid") == 0).alias("invalid_control_edges"),
        F.count_if(F.col("is_gap") == 1).alias("gap_edges"),
        F.count_if((F.col("pos") > 0) & (F.col("transition_valid") == 0)).alias("invalid_transition_examples"),
    )
    return kept.crossJoin(found)  # one row each


def vocabularies(edges: DataFrame, limits: Limits) -> dict[str, DataFrame]:
    """token and id of each vocabulary, written; ``edges`` have row_id, in whose order ties stand."""
    out = {}
    for name, fields in SHARED.items():
        each = [edges.select(F.col(f).alias("token"), (F.col("row_id") * len(fields) + i).alias("seen")) for i, f in enumerate(fields)]
        counts = vocab.token_counts(each[0] if len(each) == 1 else each[0].unionByName(each[1]), ["token"], "seen")
        reserved = RESERVED_NODES if name == "node" else ()
        size = getattr(limits, name)
        room = size - vocab.FIRST_ID - len(reserved) if size else 0
        top = vocab.build(counts, "token", room, reserved=reserved) if room or not size else counts.select("token", F.lit(0).cast("long").alias("id")).limit(0)
        if reserved:
            fixed = edges.sparkSession.createDataFrame([(t, vocab.FIRST_ID + i) for i, t in enumerate(reserved)], "token string, id long")
            top = fixed.unionByName(top)
        out[name] = materialize(top, f"vocabulary-{name}")
    return out


def encoded_rows(edges: DataFrame, vocabs: dict[str, DataFrame], by: list[str], limits: Limits) -> DataFrame:
    """row_id, the ids of ``INPUTS`` and dst_node, and ``FLAGS``: a padding row of zeros before each segment."""
    rows = edges
    for name, fields in SHARED.items():
        rows = vocab.encode(rows, vocabs[name], {f: f"id_{f}" for f in fields}, "token")
    ids = [*INPUTS[:-1], "dst_node"]
    rows = rows.select("row_id", *[F.col(f"id_{f}").cast("int").alias(f) for f in ids], control.count_bucket(F.col("icount_raw"), limits.count_clip).cast("int").alias("icount"), *FLAGS)
    padding = edges.groupBy(*by).agg((F.min("row_id") - 1).alias("row_id")).select("row_id", *[F.lit(0).alias(c) for c in [*ids, "icount", *FLAGS]])
    return padding.unionByName(rows).select("row_id", *INPUTS, "dst_node", *FLAGS)


@dataclass
class Dataset:
    """What is made of segments, each part when it is first asked for: counts need neither row ids nor vocabularies."""

    segments: DataFrame
    by: list[str]
    limits: Limits

    def _long(self) -> DataFrame:
        return self.segments.filter(F.size("tokens") >= self.limits.min_length)

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(windows.row_ids(raw_edges(self._long(), self.by), self.by, ["pos"]).withColumn("row_id", F.col("row_id").cast("long")), "edges")

    @cached_property
    def vocabs(self) -> dict[str, DataFrame]:
        return vocabularies(self.edges, self.limits)

    @cached_property
    def rows(self) -> DataFrame:
        return encoded_rows(self.edges, self.vocabs, self.by, self.limits)

    @cached_property
    def stats(self) -> DataFrame:
        edges = self.edges if "edges" in vars(self) else raw_edges(self._long(), self.by)
        return scan_stats(self.segments, edges, self.by, self.limits)


def build(segments: DataFrame, by: list[str], limits: Limits | None = None) -> Dataset:
    """Rows, vocabularies and counts of segments (``by`` in whose order they stand, and tokens)."""
    return Dataset(segments, by, limits or Limits())


def sizes(vocabs: dict[str, DataFrame], limits: Limits) -> dict[str, int]:
    """Ids of each vocabulary, with padding and out-of-vocabulary, and of instruction counts."""
    return {name: v.count() + vocab.FIRST_ID for name, v in vocabs.items()} | {"icount": limits.count_clip + 3}


def write(data: Dataset, path: str, limits: Limits | None = None) -> None:
    """``rows`` and ``vocabulary`` as Parquet and ``meta`` as one JSON line under ``path``; meta is written last and marks a whole dataset."""
    limits = limits or Limits()
    data.rows.repartitionByRange("row_id").sortWithinPartitions("row_id").write.parquet(f"{path}/rows")
    every = None
    for name, v in data.vocabs.items():
        part = v.select(F.lit(name).alias("name"), "token", "id")
        every = part if every is None else every.unionByName(part)
    every.write.parquet(f"{path}/vocabulary")
    stats = data.stats.first().asDict()
    meta = {"format_version": FORMAT_VERSION, "input_fields": INPUTS, "target_fields": {"next_dst_node": "dst_node", "next_ctrl_type": "ctrl_type"}, "aux_fields": FLAGS, "total_rows": stats["edges"] + stats["segments_kept"], "total_edges": stats["edges"], "total_segments": stats["segments_kept"], "total_examples": stats["examples"], "instruction_count_clip": limits.count_clip, "min_segment_length": limits.min_length, "vocab_sizes": sizes(data.vocabs, limits), "scan_stats": stats}
    data.rows.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/meta").collect()))  # one line


def read_vocabulary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """token and id, the two reserved ids included; an error if a token or an id occurs twice."""
    own = spark.read.parquet(f"{path}/vocabulary").filter(F.col("name") == name).select("token", "id")
    n, tokens, ids, least = own.agg(F.count("*"), F.count_distinct("token"), F.count_distinct("id"), F.min("id")).first()
    if n != tokens or n != ids or (n and least < vocab.FIRST_ID):
        raise ValueError(f"vocabulary {name} has repeated or reserved ids")
    return spark.createDataFrame([("<PAD>", vocab.PAD_ID), ("<OOV>", vocab.OOV_ID)], "token string, id long").unionByName(own)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def ready(spark: SparkSession, path: str) -> bool:
    """Whether a whole dataset of this format lies under ``path``."""
    from pyspark.errors import AnalysisException

    try:
        meta = read_meta(spark, path)
        rows = read_rows(spark, path)
        if meta.get("format_version") != FORMAT_VERSION or meta.get("input_fields") != INPUTS or meta.get("aux_fields") != FLAGS or rows.columns != ["row_id", *INPUTS, "dst_node", *FLAGS]:
            return False
        n, least, most = rows.agg(F.count("*"), F.min("row_id"), F.max("row_id")).first()
        if not n or n != meta.get("total_rows") or (least, most) != (0, n - 1):
            return False
        have = {r["name"]: r["count"] + vocab.FIRST_ID for r in spark.read.parquet(f"{path}/vocabulary").groupBy("name").count().collect()}  # five names
        return all(have.get(name, vocab.FIRST_ID) == meta["vocab_sizes"].get(name) for name in SHARED)
    except (AnalysisException, ValueError, KeyError, AttributeError):
        return False
