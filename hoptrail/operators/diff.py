"""Two versions of functions compared: blocks mapped by a cascade, then blocks, edges and functions rated.

Sides are tables of many function pairs at once. Blocks: pair_id, block,
relative_offset, terminal_flow, address_count, instruction_count, mnemonic_hash,
instruction_hash; edges: pair_id, src, dst, type (distinct).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.literals import signed_hex
from hoptrail.operators.graph import block_similarity, block_status, degrees, function_status
from hoptrail.operators.joins import both_ways, mutual_best, propagate
from hoptrail.operators.windows import numbered
from hoptrail.written import materialize

#: The likeness that a block's best match needs, and its lead over the next one.
LEAST, LEAD = 0.60, 0.05
SEP = "\x1f"


@dataclass
class Side:
    """One version: blocks with a key over all pairs, and edges between keys."""

    blocks: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, blocks: DataFrame, edges: DataFrame, name: str) -> Side:
        key = lambda c: F.concat_ws(SEP, F.col("pair_id").cast("string"), F.col(c).cast("string"))
        keyed = materialize(edges.select("pair_id", key("src").alias("src"), key("dst").alias("dst"), "type"), f"{name}-edges")
        counted = blocks.withColumn("key", key("block")).join(degrees(keyed, "src", "dst").withColumnRenamed("node", "key"), "key", "left").fillna(0, ["in_degree", "out_degree"])
        return cls(materialize(counted, f"{name}-blocks"), keyed)


def _unique(left: DataFrame, right: DataFrame, fields: list[str], method: str) -> DataFrame:
    """Pairs of free blocks of a function pair that alone share ``fields`` on either side."""

    def once(blocks: DataFrame, own: str) -> DataFrame:
        return blocks.groupBy("pair_id", *fields).agg(F.count("*").alias("_n"), F.min("key").alias(own)).filter("_n = 1").drop("_n")

    return once(left, "o").join(once(right, "n"), ["pair_id", *fields]).select("o", "n", F.lit(method).alias("method"))


def _rest(left: DataFrame, right: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The free blocks after ``more`` is mapped, of function pairs that have some on both sides: no other pair can grow."""
    left = materialize(left.join(more.select(F.col("o").alias("key")), "key", "left_anti"), "free")
    right = right.join(more.select(F.col("n").alias("key")), "key", "left_anti")
    right = materialize(right.join(left.select("pair_id").distinct(), "pair_id", "left_semi"), "free")
    return materialize(left.join(right.select("pair_id").distinct(), "pair_id", "left_semi"), "free"), right


def map_blocks(old: Side, new: Side) -> DataFrame:
    """o, n (keys) and method of the blocks that correspond; the cascade ends when likeness adds nothing.

    A step writes the pairs it adds, and the blocks that are still free; later steps read these and their functions' edges alone.
    """

    def unique(fields: list[str], method: str) -> None:
        nonlocal mapped, left, right
        more = materialize(_unique(left, right, fields, method), "mapped")
        mapped, (left, right) = mapped.unionByName(more), _rest(left, right, more)

    def grow() -> None:
        nonlocal mapped, left, right
        live = left.select("pair_id").distinct()
        both = [both_ways(s.edges.join(live, "pair_id", "left_semi")) for s in (old, new)]
        # A neighbour may be reached both ways: then it counts as reached outwards.
        found = propagate(mapped.select("o", "n"), *both, named=True).filter("how IS NOT NULL")
        more = materialize(found.select("o", "n", F.when(F.col("how").startswith("out:"), "mapped_neighbor_out").otherwise("mapped_neighbor_in").alias("method")), "mapped")
        mapped, (left, right) = mapped.unionByName(more), _rest(left, right, more)

    columns = ["key", "pair_id", "relative_offset", "terminal_flow", "in_degree", "out_degree", "instruction_count", "mnemonic_hash", "instruction_hash"]
    left, right = (s.blocks.select(*columns) for s in (old, new))
    mapped = materialize(_unique(*(x.filter("relative_offset = 0") for x in (left, right)), [], "entry"), "mapped")
    # Nearly every pair is live after its entry: only the entries themselves go.
    left, right = (materialize(x.join(mapped.select(F.col(own).alias("key")), "key", "left_anti"), "free") for x, own in ((left, "o"), (right, "n")))
    shape = ["terminal_flow", "in_degree", "out_degree"]
    unique(["instruction_hash", *shape], "unique_instruction_block")
    unique(["mnemonic_hash", *shape], "unique_mnemonic_block")
    grow()
    unique(["mnemonic_hash", *shape, "relative_offset"], "same_relative_structure")
    while True:
        a, b = left.alias("a"), right.alias("b")
        same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
        gap = F.abs(F.col("a.in_degree") - F.col("b.in_degree")) + F.abs(F.col("a.out_degree") - F.col("b.out_degree"))
        most = F.greatest(F.col("a.instruction_count"), F.col("b.instruction_count"), F.lit(1))
        ratio = 1 - F.abs(F.col("a.instruction_count") - F.col("b.instruction_count")) / most
        likeness = block_similarity(same("instruction_hash"), same("mnemonic_hash"), same("terminal_flow"), gap, ratio, same("relative_offset"))
        pairs = a.join(b, same("pair_id")).select(F.col("a.key").alias("o"), F.col("b.key").alias("n"), F.round(likeness, 9).alias("similarity"))
        more = materialize(mutual_best(pairs, LEAST, LEAD).select("o", "n", F.lit("mutual_best_similarity").alias("method")), "alike")
        if more.isEmpty():
            return mapped
        mapped, (left, right) = mapped.unionByName(more), _rest(left, right, more)
        grow()


def block_rows(old: Side, new: Side, mapped: DataFrame) -> DataFrame:
    """One row for each block of either version, with its status and what it was and is."""
    keep = ["pair_id", "block", "relative_offset", "instruction_count", "address_count", "mnemonic_hash", "instruction_hash"]
    a = old.blocks.select(F.col("key").alias("o"), *[F.col(c).alias(f"old_{c}") for c in keep])
    b = new.blocks.select(F.col("key").alias("n"), *[F.col(c).alias(f"new_{c}") for c in keep])
    all_ = a.join(mapped, "o", "left").join(b, "n", "full_outer")
    status = block_status(F.col("old_block"), F.col("new_block"), F.col("old_instruction_hash") == F.col("new_instruction_hash"), F.col("old_relative_offset") == F.col("new_relative_offset"))
    return all_.select(
        F.coalesce("old_pair_id", "new_pair_id").alias("pair_id"),
        status.alias("status"),
        "method",
        *[c for s in ("old", "new") for c in (F.col(f"{s}_block"), signed_hex(F.col(f"{s}_relative_offset")).alias(f"{s}_offset"), F.col(f"{s}_instruction_count"), F.col(f"{s}_address_count"), F.col(f"{s}_mnemonic_hash"), F.col(f"{s}_instruction_hash"))],
    )


def edge_rows(old: Side, new: Side, mapped: DataFrame) -> DataFrame:
    """Edges that aren't the same: TYPE_CHANGED, REMOVED or ADDED; an edge with mapped ends changed its type if one new edge alone is left between them."""
    to = mapped.select("o", "n")
    named = old.edges.join(to.withColumnRenamed("o", "src").withColumnRenamed("n", "a"), "src", "left").join(to.withColumnRenamed("o", "dst").withColumnRenamed("n", "b"), "dst", "left")
    there = new.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", F.lit(True).alias("same"))
    judged = materialize(named.join(there, ["a", "b", "type"], "left"), "edges")
    rest_old = judged.filter("same IS NULL")
    kept = judged.filter("same").select("a", "b", "type")
    rest_new = new.edges.withColumnsRenamed({"src": "a", "dst": "b"}).join(kept, ["a", "b", "type"], "left_anti")
    # Between two blocks, the first old edge left takes the only new one left.
    sole = rest_new.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("type").alias("new_type")).filter("c = 1").drop("c")
    first = rest_old.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.min("type").alias("type"))
    changed = materialize(first.join(sole, ["a", "b"]), "changed")
    out = rest_old.join(changed, ["a", "b", "type"], "left").select("pair_id", F.when(F.col("new_type").isNull(), "REMOVED").otherwise("TYPE_CHANGED").alias("status"), F.col("src").alias("old_src"), F.col("dst").alias("old_dst"), F.col("type").alias("old_type"), F.when(F.col("new_type").isNotNull(), F.col("a")).alias("new_src"), F.when(F.col("new_type").isNotNull(), F.col("b")).alias("new_dst"), "new_type")
    none = F.lit(None).cast("string")
    added = rest_new.join(changed.select("a", "b", F.col("new_type").alias("type")), ["a", "b", "type"], "left_anti").select("pair_id", F.lit("ADDED").alias("status"), none.alias("old_src"), none.alias("old_dst"), none.alias("old_type"), F.col("a").alias("new_src"), F.col("b").alias("new_dst"), F.col("type").alias("new_type"))
    plain = lambda c: F.substring_index(c, SEP, -1).alias(c)
    all_ = out.unionByName(added)
    return all_.select("pair_id", "status", *[plain(c) if c.endswith(("src", "dst")) else F.col(c) for c in all_.columns[2:]])


def summaries(pairs: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each pair: counts and the function's status.

    ``pairs``: pair_id, old_status and new_status (OK, PARTIAL or FAILED), and both sides' layout, topology and instruction hash.
    """
    moved, status = F.col("status").isin("MOVED", "MODIFIED_MOVED"), F.col("status")
    b = blocks.groupBy("pair_id").agg(
        F.count_if(status == "ADDED").alias("blocks_added"), F.count_if(status == "REMOVED").alias("blocks_removed"),
        F.count_if(status.startswith("MODIFIED")).alias("blocks_modified"), F.count_if(moved).alias("blocks_moved"), F.count_if(F.col("method").isNotNull()).alias("mapped_block_count"),
    )
    e = edges.groupBy("pair_id").agg(*[F.count_if(status == s).alias(f"edges_{s.lower()}") for s in ("ADDED", "REMOVED", "TYPE_CHANGED")])
    counts = [c for c in (*b.columns, *e.columns) if c != "pair_id"]
    all_ = pairs.join(b, "pair_id", "left").join(e, "pair_id", "left").fillna(0, counts)
    equal = lambda h: F.col(f"old_{h}_hash").eqNullSafe(F.col(f"new_{h}_hash"))
    either = lambda s: (F.col("old_status") == s) | (F.col("new_status") == s)
    complete = (F.col("blocks_added") == 0) & (F.col("blocks_removed") == 0)
    some: Column = F.lit(False)
    for c in ("blocks_added", "blocks_removed", "edges_added", "edges_removed", "edges_type_changed"):
        some = some | (F.col(c) > 0)
    verdict = function_status(either("FAILED"), either("PARTIAL"), ~complete & equal("topology"), some | ~equal("topology"), (F.col("blocks_modified") > 0) | ~equal("instruction"), (F.col("blocks_moved") > 0) | ~equal("layout"))
    return all_.select("pair_id", verdict.alias("status"), complete.alias("mapping_complete"), equal("topology").alias("topology_equal"), equal("layout").alias("layout_equal"), equal("instruction").alias("instruction_equal"), *counts)


def match_rows(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """MATCHED, AMBIGUOUS, OLD_ONLY and NEW_ONLY rows of functions (name, entry, signature) after ``matches`` (old_entry, new_entry, method, confidence).

    Functions left on both sides of a name are one ambiguous row, of entries and signatures in order. Matches have a pair_id, numbered in the order of name, old and new entry.
    """
    a = old.select("name", F.col("entry").alias("old_entry"), F.col("signature").alias("old_signature"))
    b = new.select("name", F.col("entry").alias("new_entry"), F.col("signature").alias("new_signature"))
    matched = matches.join(a, "old_entry").join(b.drop("name"), "new_entry").select(F.lit("MATCHED").alias("status"), "name", "old_entry", "new_entry", "old_signature", "new_signature", "method", "confidence")
    left = a.join(matches.select("old_entry"), "old_entry", "left_anti").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("old_entry", "old_signature"))).alias("x"))
    right = b.join(matches.select("new_entry"), "new_entry", "left_anti").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("new_entry", "new_signature"))).alias("y"))
    rest = left.join(right, "name", "full_outer")
    none = F.lit(None).cast("string")
    listed = lambda c, f: F.array_join(F.transform(c, lambda r: r[f]), ";").alias(f)
    twice = rest.filter("x IS NOT NULL AND y IS NOT NULL").select(F.lit("AMBIGUOUS").alias("status"), "name", listed("x", "old_entry"), listed("y", "new_entry"), listed("x", "old_signature"), listed("y", "new_signature"), none.alias("method"), none.alias("confidence"))
    one = rest.filter("y IS NULL").select("name", F.explode("x").alias("r")).select(F.lit("OLD_ONLY").alias("status"), "name", "r.old_entry", none.alias("new_entry"), "r.old_signature", none.alias("new_signature"), none.alias("method"), none.alias("confidence"))
    two = rest.filter("x IS NULL").select("name", F.explode("y").alias("r")).select(F.lit("NEW_ONLY").alias("status"), "name", none.alias("old_entry"), "r.new_entry", none.alias("old_signature"), "r.new_signature", none.alias("method"), none.alias("confidence"))
    matched = numbered(matched, ["name", "old_entry", "new_entry"], "_n").withColumn("pair_id", F.format_string("F%06d", "_n")).drop("_n")
    return matched.unionByName(twice.unionByName(one).unionByName(two), allowMissingColumns=True)
