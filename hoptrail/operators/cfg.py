"""Static control flow from ingested instruction facts: edges, call sites and graph, return and indirect sites.

``facts``: function, block, address, mnemonic, operands (array), returns (what the
semantics say), call, jump, conditional, computed, terminal, fallthrough, targets
(array of addresses), last (of its block), text. ``destinations``: function, block,
source, destination and the flags of the flow, as a block model has them.
``places``: address, place_function and place_block of every instruction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.control import confidence_rank, edge_class, return_kind
from hoptrail.operators.graph import keep_best
from hoptrail.operators.joins import interval_join, merged_ranges
from hoptrail.written import materialize

#: Where an edge is known from, and how sure that is.
FLOW, FALLTHROUGH, BLOCKS = "ghidra_instruction_flow", "instruction_fallthrough", "block_model"
EDGE = ["src_function", "dst_function", "src_block", "dst_block", "src_address", "dst_address", "type", "interprocedural", "indirect", "resolution", "confidence"]


@dataclass
class Tables:
    """What ``tables`` gives."""

    edges: DataFrame
    call_sites: DataFrame
    call_graph: DataFrame
    return_sites: DataFrame
    indirect_sites: DataFrame


def relative_offset(address: Column, entry: Column) -> Column:
    """Distance of an address from its function's entry; may be negative."""
    return address - entry


def _sure(computed: Column) -> Column:
    return F.when(computed, "medium").otherwise("high")


def _flow(call: Column, jump: Column, terminal: Column, fallthrough: Column) -> Column:
    return F.when(fallthrough, "fallthrough").when(call, "call").when(jump, "jump").when(terminal, "terminal").otherwise("unknown")


def with_returns(facts: DataFrame) -> DataFrame:
    """``facts`` with return_kind and detection, empty for instructions that don't return."""
    found = return_kind(F.col("mnemonic"), F.col("operands"), F.col("returns"))
    return facts.withColumns({"return_kind": found["kind"], "detection": found["method"]})


def _candidates(facts: DataFrame, destinations: DataFrame) -> DataFrame:
    """All edges as they are proposed: by instruction flows, by fall-throughs at block borders, and by the block model."""
    goes = facts.filter("return_kind = ''")
    own = [F.col("function").alias("src_function"), F.col("block").alias("src_block")]
    no = F.lit(False)
    flows = goes.select(*own, F.col("address").alias("src_address"), F.explode("targets").alias("dst_address"), edge_class(_flow(F.col("call"), F.col("jump"), F.col("terminal"), no), F.col("conditional"), F.col("computed"), no).alias("type"), F.col("computed").alias("indirect"), F.lit(FLOW).alias("resolution"), _sure(F.col("computed")).alias("confidence"))
    # Only fall-throughs at block borders are edges; what follows calls and conditions is one, too.
    kind = F.when(F.col("call"), "call_fallthrough").when(F.col("conditional"), "conditional_not_taken").when(~F.col("jump") & ~F.col("terminal"), "fallthrough")
    border = goes.filter(F.col("fallthrough").isNotNull() & (F.col("last") | F.col("call") | F.col("conditional")))
    falls = border.select(*own, F.col("address").alias("src_address"), F.col("fallthrough").alias("dst_address"), kind.alias("type"), no.alias("indirect"), F.lit(FALLTHROUGH).alias("resolution"), F.lit("high").alias("confidence")).filter("type IS NOT NULL")
    source = facts.select(F.col("address").alias("source"), F.col("call").alias("source_call"), F.col("conditional").alias("source_conditional"), "return_kind")
    d = destinations.join(source, "source", "left").filter(F.coalesce("return_kind", F.lit("")) == "")
    # A fall-through is named after its source, any other flow after itself.
    named = edge_class(_flow(F.col("call"), F.col("jump"), F.col("terminal"), F.col("is_fallthrough")), F.when(F.col("is_fallthrough"), F.coalesce("source_conditional", no)).otherwise(F.col("conditional")), F.col("computed"), F.coalesce("source_call", no))
    blocks = d.select(*own, F.col("source").alias("src_address"), F.col("destination").alias("dst_address"), named.alias("type"), F.col("computed").alias("indirect"), F.lit(BLOCKS).alias("resolution"), _sure(F.col("computed")).alias("confidence"))
    return flows.unionByName(falls).unionByName(blocks)


def tables(facts: DataFrame, destinations: DataFrame, places: DataFrame, complete_sites: DataFrame) -> Tables:
    """All tables; ``complete_sites`` has the addresses whose jump table is known whole."""
    facts = with_returns(facts)
    proposed = _candidates(facts, destinations)
    there = places.select(F.col("address").alias("dst_address"), F.col("place_function").alias("dst_function"), F.col("place_block").alias("dst_block"))
    placed = proposed.join(there, "dst_address", "left")
    crosses = F.coalesce((F.col("dst_function") != F.col("src_function")), F.lit(False))
    tail = crosses & F.col("type").isin("direct_jump", "indirect_jump")
    placed = placed.withColumn("interprocedural", crosses).withColumn("type", F.when(tail, "tail_call").otherwise(F.col("type")))
    order = [F.when(F.col("resolution") == FLOW, 0).when(F.col("resolution") == FALLTHROUGH, 1).otherwise(2)]
    edges = keep_best(placed.select(*EDGE), ["src_address", "dst_address", "type"], confidence_rank(F.col("confidence")), order)

    after = facts.select(F.col("address").alias("src_address"), F.col("fallthrough").alias("continuation"))
    called = placed.filter(F.col("type").isin("direct_call", "indirect_call", "tail_call")).join(after, "src_address", "left")
    site = ["caller", "call_site", "kind", "callee", "continuation", "resolution", "confidence"]
    calls = called.select(F.col("src_function").alias("caller"), F.col("src_address").alias("call_site"), F.col("type").alias("kind"), F.col("dst_address").alias("callee"), F.when(F.col("type") != "tail_call", F.col("continuation")).alias("continuation"), "resolution", "confidence", "dst_function")
    open_ = facts.filter(F.col("call") & (F.size("targets") == 0) & (F.col("return_kind") == "")).select(F.col("function").alias("caller"), F.col("address").alias("call_site"), F.when(F.col("computed"), "indirect_call").otherwise("direct_call").alias("kind"), F.lit(None).cast("long").alias("callee"), F.col("fallthrough").alias("continuation"), F.lit("unresolved").alias("resolution"), F.lit("low").alias("confidence"))
    rank = confidence_rank(F.col("confidence"))
    call_sites = keep_best(calls.select(*site).unionByName(open_), ["call_site", "callee", "kind"], rank, order)
    into = calls.filter(F.col("dst_function").isNotNull()).select("caller", F.col("dst_function").alias("callee"), "kind", "resolution", "confidence")
    call_graph = keep_best(into, ["caller", "callee", "kind"], rank, order)

    return_sites = facts.filter("return_kind != ''").select("function", "block", "address", F.col("return_kind").alias("kind"), "detection", "text")
    computed = facts.filter(F.col("computed") & (F.col("return_kind") == "")).select("function", "block", "address", F.when(F.col("call"), "indirect_call").otherwise("indirect_jump").alias("kind"), "text")
    to = placed.filter(F.col("indirect")).select(F.col("src_address").alias("address"), F.col("dst_address").alias("target"), "resolution").distinct()
    whole = complete_sites.select("address").distinct().withColumn("whole", F.lit(True))
    found = computed.join(to, "address", "left").join(whole, "address", "left").groupBy("function", "block", "address", "kind", "text").agg(F.sort_array(F.collect_set("target")).alias("targets"), F.collect_set("resolution").alias("resolutions"), F.max((F.coalesce("whole", F.lit(False)) & (F.col("kind") == "indirect_jump")).cast("int")).alias("complete"))
    status = F.when(F.size("targets") == 0, "unresolved").when(F.col("complete") == 1, "resolved").otherwise("partial")
    indirect = found.select("function", "block", "address", "kind", status.alias("status"), F.size("targets").alias("n_targets"), "complete", "targets", F.sort_array(F.array_union("resolutions", F.array(F.lit("unresolved")))).alias("resolutions"), "text")
    return Tables(edges, call_sites, call_graph, return_sites, indirect)


def check_versions(old: dict, new: dict) -> list[str]:
    """Warnings of comparing two programs; different languages are an error."""
    if old["language_id"] != new["language_id"]:
        raise ValueError(f"languages differ: {old['language_id']} and {new['language_id']}")
    return [] if old["compiler_spec"] == new["compiler_spec"] else [f"compilers differ: {old['compiler_spec']} and {new['compiler_spec']}"]




#: Phases in which a failure leaves no graph, and the error of a destination without a block.
FATAL = ("collect_blocks", "extract_cfg")
NO_BLOCK = ("resolve_destination_block", "MissingDestinationBlock")


@dataclass
class Graphs:
    """What ``function_graphs`` gives: blocks and edges of the functions that have a graph, all functions' states, and errors."""

    blocks: DataFrame
    edges: DataFrame
    states: DataFrame
    errors: DataFrame


def function_graphs(functions: DataFrame, bodies: DataFrame, blocks: DataFrame, references: DataFrame, failures: DataFrame) -> Graphs:
    """The graph of each function inside its own body.

    ``functions``: function; ``bodies``: function, start, stop (ranges that may touch or overlap); ``blocks``: function,
    block (its first address), block_stop and what else they carry; ``references``: function, src_block, dst_address,
    call and type; ``failures``: function, phase, block, error_type, message of the ingest. Calls and places outside of the
    body are no edges. A destination in the body but in no block is an error. A function with an error of ``FATAL``
    is FAILED and has no graph, with any other it is PARTIAL.
    """
    own = materialize(merged_ranges(bodies, ["function"], "start", "stop"), "bodies")
    flows = references.filter(~F.col("call")).select("function", "src_block", "dst_address", "type").distinct()
    inside = interval_join(flows, own, "dst_address", "start", "stop", "inner", by=["function"]).drop("start", "stop")
    placed = interval_join(materialize(inside, "flows"), blocks.select("function", F.col("block").alias("dst"), "block_stop"), "dst_address", "dst", "block_stop", by=["function"])
    placed = materialize(placed, "placed")
    lost = placed.filter("dst IS NULL").select("function", F.lit(NO_BLOCK[0]).alias("phase"), F.col("src_block").alias("block"), F.lit(NO_BLOCK[1]).alias("error_type"), F.concat(F.lit("no block in the body holds "), F.col("dst_address")).alias("message"))
    fatal = failures.filter(F.col("phase").isin(*FATAL)).select("function").distinct()
    errors = failures.select("function", "phase", "block", "error_type", "message").unionByName(lost.join(fatal, "function", "left_anti"))
    counted = errors.groupBy("function").agg(F.count("*").alias("n_errors"), F.max(F.col("phase").isin(*FATAL)).alias("fatal"))
    state = F.when(F.coalesce("fatal", F.lit(False)), "FAILED").when(F.col("n_errors") > 0, "PARTIAL").otherwise("OK")
    states = functions.select("function").distinct().join(counted, "function", "left").select("function", state.alias("status"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"))
    edges = placed.filter("dst IS NOT NULL").select("function", F.col("src_block").alias("src"), "dst", "type").distinct()
    return Graphs(blocks.join(fatal, "function", "left_anti"), edges.join(fatal, "function", "left_anti"), states, errors)
