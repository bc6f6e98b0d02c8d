"""Static control-flow graphs: facts, degrees, hashes and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.written import materialize

ROUNDS = 8
#: Fixed value: what the hash of a graph without nodes is made of.
EMPTY_GRAPH = "EMPTY_GRAPH"


def keep_best(df: DataFrame, keys: list[str], rank: Column, order: list[str]) -> DataFrame:
    """One row a key: the highest rank, the first on ties."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(rank), *order))).filter("_k = 1").drop("_k")


def indirect_sites(df: DataFrame, keys: list[str], target: str, complete: Column) -> DataFrame:
    """Targets of each indirect site, joined in order, and its status."""
    found = df.groupBy(*keys).agg(F.sort_array(F.collect_set(target)).alias("_t"), F.max(complete.cast("int")).alias("_c"))
    status = F.when(F.size("_t") == 0, "unresolved").when(F.col("_c") == 1, "resolved").otherwise("partial")
    return found.select(*keys, F.size("_t").cast("bigint").alias("n_targets"), F.array_join("_t", ";").alias("targets"), status.alias("status"))


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """node, in_degree, out_degree of every node that an edge touches."""
    ends = edges.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"))


def ordered_hash(df: DataFrame, keys: list[str], part: Column, out: str) -> DataFrame:
    """SHA-256 of each group's sorted parts, one a line. Groups are functions: their parts fit a row."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(part)), "\n"), 256).alias(out))


def _hashed(parts: Column) -> Column:
    """SHA-256 of an array of texts, joined by the unit separator."""
    return F.sha2(F.array_join(parts, "\x1f"), 256)


def fingerprint(nodes: DataFrame, edges: DataFrame, graph: str, labels: list[Column], rounds: int = ROUNDS) -> DataFrame:
    """A hash of each graph that doesn't depend on node names, by colour refinement.

    ``nodes`` has graph, node and what ``labels`` read (a mark of the entry, the terminal
    flow; then come the degrees, then ``labels`` beyond two, such as a block's hash);
    ``edges`` has distinct graph, src, dst, type. A graph of n nodes refines min(max(n, 1), rounds)
    times. The hash is of the sorted colours and the sorted edges as colour:type:colour, with their numbers.
    """
    size = nodes.groupBy(graph).agg(F.least(F.greatest(F.count("*"), F.lit(1)), F.lit(rounds)).alias("_rounds"))
    inside = edges.join(nodes.select(graph, F.col("node").alias("src")), [graph, "src"], "left_semi").join(nodes.select(graph, F.col("node").alias("dst")), [graph, "dst"], "left_semi")
    inside = materialize(inside.select(graph, "src", "dst", "type"), "edges")
    ends = inside.select(graph, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(inside.select(graph, F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degree = ends.groupBy(graph, "node").agg(F.sum("i").alias("_i"), F.sum("o").alias("_o"))
    known = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    first = _hashed(F.array(*labels[:2], known(F.col("_i")), known(F.col("_o")), *labels[2:]))
    colours = materialize(nodes.join(degree, [graph, "node"], "left").select(graph, "node", first.alias("colour")).join(size, graph), "colours")
    marked = lambda mark, c: F.concat(F.array(F.lit(mark)), F.coalesce(c, F.array().cast("array<string>")))
    # Both directions of an edge in one table: a round is one join and one aggregation of it.
    ways = materialize(inside.select(graph, F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("OUT").alias("way"), "type").unionByName(inside.select(graph, F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("IN").alias("way"), "type")), "ways")
    around = lambda way: F.sort_array(F.collect_list(F.when(F.col("way") == way, F.concat_ws(":", "type", "colour"))))
    for turn in range(size.agg(F.coalesce(F.max("_rounds"), F.lit(0))).first()[0]):  # each round is written: the next reads it twice
        near = ways.join(colours.select(graph, F.col("node").alias("other"), "colour"), [graph, "other"]).groupBy(graph, "node").agg(around("OUT").alias("outs"), around("IN").alias("ins"))
        nxt = _hashed(F.concat(F.array("colour"), marked("IN", F.col("ins")), marked("OUT", F.col("outs"))))
        colours = materialize(colours.join(near, [graph, "node"], "left").select(graph, "node", F.when(F.col("_rounds") > turn, nxt).otherwise(F.col("colour")).alias("colour"), "_rounds"), "colours")
    named = inside
    for end in ("src", "dst"):
        named = named.join(colours.select(graph, F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")), [graph, end])
    lines = lambda df, part, out: df.groupBy(graph).agg(F.sort_array(F.collect_list(part)).alias(out))
    both = lines(colours, F.col("colour"), "_nodes").join(lines(named, F.concat_ws(":", "src_colour", "type", "dst_colour"), "_edges"), graph, "left")
    both = both.join(edges.groupBy(graph).agg(F.count("*").alias("_n")), graph, "left")
    counted = lambda name, n, c: marked(name, F.concat(F.array(n.cast("string")), F.coalesce(c, F.array().cast("array<string>"))))
    text = F.concat(counted("NODES", F.size("_nodes"), F.col("_nodes")), counted("EDGES", F.coalesce("_n", F.lit(0)), F.col("_edges")))
    return both.select(graph, _hashed(text).alias("fingerprint"))


def cfg_hashes(functions: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """function with its layout, topology, mnemonic and instruction hash; a function without blocks has the empty graph's.

    ``blocks``: function, block, relative_offset, address_count, instruction_count, terminal_flow,
    mnemonic_hash, instruction_hash; ``edges``: function, src, dst (blocks) and type.
    """
    at = blocks.select("function", "block", "relative_offset")
    placed = edges.join(at.select("function", F.col("block").alias("src"), F.col("relative_offset").alias("a")), ["function", "src"]).join(at.select("function", F.col("block").alias("dst"), F.col("relative_offset").alias("b")), ["function", "dst"])
    # Order: all blocks by offset, then all edges by their blocks and type.
    parts = blocks.select("function", F.struct(F.lit(0).alias("kind"), F.col("relative_offset").alias("x"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("d"), F.lit("").alias("t")).alias("o"), F.concat_ws(":", F.lit("B"), "relative_offset", "address_count", "instruction_count").alias("part"))
    parts = parts.unionByName(placed.select("function", F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("x"), F.col("src").alias("s"), F.col("dst").alias("d"), F.col("type").alias("t")).alias("o"), F.concat_ws(":", F.lit("E"), "a", "b", "type").alias("part")))
    layout = parts.groupBy("function").agg(_hashed(F.transform(F.sort_array(F.collect_list(F.struct("o", "part"))), lambda x: x["part"])).alias("layout_hash"))
    nodes = blocks.withColumnRenamed("block", "node")
    base = [F.when(F.col("relative_offset") == 0, "ENTRY").otherwise("NODE"), F.col("terminal_flow")]
    out = functions.select("function").distinct().join(layout, "function", "left").withColumn("layout_hash", F.coalesce("layout_hash", F.sha2(F.lit(""), 256)))
    for name, more in (("topology", []), ("mnemonic", [F.col("mnemonic_hash")]), ("instruction", [F.col("instruction_hash")])):
        found = fingerprint(nodes, edges, "function", [*base, *more]).withColumnRenamed("fingerprint", f"{name}_hash")
        out = out.join(found, "function", "left").withColumn(f"{name}_hash", F.coalesce(f"{name}_hash", F.sha2(F.lit(EMPTY_GRAPH), 256)))
    return out


def block_similarity(same_instructions: Column, same_mnemonics: Column, same_flow: Column, degree_gap: Column, count_ratio: Column, same_offset: Column) -> Column:
    """Weighted likeness of two basic blocks, between 0 and 1."""
    yes = lambda c: c.cast("double")
    return 0.30 * yes(same_instructions) + 0.25 * yes(same_mnemonics) + 0.15 * yes(same_flow) + 0.15 / (1 + degree_gap) + 0.10 * count_ratio + 0.05 * yes(same_offset)


def block_status(old: Column, new: Column, same_content: Column, same_place: Column) -> Column:
    return (
        F.when(new.isNull(), "REMOVED")
        .when(old.isNull(), "ADDED")
        .when(same_content & same_place, "UNCHANGED")
        .when(same_content, "MOVED")
        .when(same_place, "MODIFIED")
        .otherwise("MODIFIED_MOVED")
    )


def function_status(failed: Column, partial: Column, ambiguous: Column, cfg_changed: Column, content_changed: Column, layout_changed: Column) -> Column:
    """The first that holds, in this order."""
    return F.when(failed, "ANALYSIS_FAILED").when(partial, "ANALYSIS_PARTIAL").when(ambiguous, "BLOCK_MAPPING_AMBIGUOUS").when(cfg_changed, "CFG_CHANGED").when(content_changed, "CONTENT_ONLY").when(layout_changed, "LAYOUT_ONLY").otherwise("UNCHANGED")
