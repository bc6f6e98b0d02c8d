"""Registered queries that no SQL checks: loops until stable and deep refinement over whole tables.

``catalogue`` has their forms of as many rounds as SQL can unroll.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hoptrail.operators import diff, graph, joins, sequential
from hoptrail.written import materialize


def q_wl_fingerprint_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of 12 nodes whose nodes carry a hash of their own, by all rounds of refinement."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = li.select((F.col("l_orderkey") % 40).alias("g"), (F.col("l_partkey") % 12).alias("src"), (F.col("l_suppkey") % 12).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    n = e.select("g", F.col("src").alias("node")).union(e.select("g", "dst")).distinct()
    return graph.fingerprint(n, e, "g", [F.when(F.col("node") == 0, "ENTRY").otherwise("NODE"), F.lit("flow"), (F.col("node") % 3).cast("string")])


def q_neighbor_propagate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs grown from a quarter of the orders along the edges of all orders, both ways, until none is added."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, nodes = F.col("l_orderkey"), F.lit(li.agg(F.coalesce(F.max("l_orderkey"), F.lit(0))).first()[0] + 1)
    edges = lambda rows, shift: rows.select((k + shift).alias("src"), (k * 3 % nodes + shift).alias("dst"), F.col("l_returnflag").alias("type")).distinct()
    seeds = li.filter(k % 4 == 0).select(k.alias("o"), (k + 10000).alias("n")).distinct()
    return joins.propagate(seeds, joins.both_ways(edges(li, 0)), joins.both_ways(edges(li.filter(k % 11 != 0), 10000)))


def function_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks and edges of two versions of a function for each order: blocks are its line numbers, some moved, changed or gone."""
    rest = F.struct("l_returnflag", "l_quantity", "l_partkey", "l_suppkey", "l_linestatus")
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    there = ~((k % 3 == 0) & (i == 3))
    # Both versions and their edges are read from one table, which one shuffle by order makes.
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(rest).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    order = Window.partitionBy("l_orderkey")
    follows = F.lead("l_linenumber").over(order.orderBy("l_linenumber")) == i + 1
    kept_next = F.lead(there).over(order.orderBy("l_linenumber"))
    li = materialize(li.withColumns({"follows": k.isNotNull() & follows, "follows_new": k.isNotNull() & there & follows & kept_next, "led": k.isNotNull() & (F.min("l_linenumber").over(order) == 1)}), "versions")

    def blocks(offset, content):
        return [k.alias("pair_id"), i.alias("block"), offset.cast("long").alias("relative_offset"), F.col("l_returnflag").alias("terminal_flow"), (i * 4).cast("long").alias("address_count"), F.col("l_quantity").cast("long").alias("instruction_count"), F.concat(F.lit("m"), F.col("l_partkey") % 50).alias("mnemonic_hash"), content.alias("instruction_hash")]

    plain = F.concat(F.lit("i"), "l_suppkey")
    old = li.select(*blocks((i - 1) * 16, plain))
    new = li.filter(there).select(*blocks((i - 1) * 16 + F.when((k % 5 == 0) & (i > 3), 16).otherwise(0), F.when((k % 7 == 0) & (i == 2), F.concat(plain, F.lit("x"))).otherwise(plain)))
    first = F.lit(1).cast(li.schema["l_linenumber"].dataType)

    def edges(follows_: str, jumping: Column, changes: Column) -> DataFrame:
        steps = li.filter(follows_).select(k.alias("pair_id"), i.alias("src"), (i + 1).alias("dst"), F.lit("fallthrough").alias("type"))
        jumps = li.filter(jumping).select(k.alias("pair_id"), i.alias("src"), first.alias("dst"), F.when(changes, "direct_jump").otherwise("conditional_taken").alias("type"))
        return steps.unionByName(jumps)

    jumps = F.col("led") & F.expr("l_linestatus = 'O' AND l_linenumber > 2")  # block 1 is in either version, or in none
    return old, edges("follows", jumps, F.lit(False)), new, edges("follows_new", jumps & there, k % 11 == 0)


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[diff.Side, diff.Side, DataFrame]:
    old_blocks, old_edges, new_blocks, new_edges = function_versions(spark, sf_dir)
    old, new = diff.Side.of(old_blocks, old_edges, "old"), diff.Side.of(new_blocks, new_edges, "new")
    return old, new, diff.map_blocks(old, new)


def q_block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of two versions of all functions, mapped by the whole cascade, with its status."""
    return diff.block_rows(*_mapped(spark, sf_dir))


def q_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of two versions that differ under the mapping of their blocks."""
    return diff.edge_rows(*_mapped(spark, sf_dir))


def q_return_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that returns pop, and the depth of the stack, along every user's events: views call, purchases return."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "call").when(F.col("event_type") == "purchase", "return").otherwise("other")
    rows = e.select("user_id", "ts", F.col("event_id").alias("row_id"), kind.alias("kind"), (F.col("event_id") * 4).alias("address"))
    return sequential.return_stack(rows, ["user_id"], ["ts", "row_id"], depth=8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (q_wl_fingerprint_whole, q_neighbor_propagate_whole, q_block_diff, q_edge_rows, q_return_stack)}
