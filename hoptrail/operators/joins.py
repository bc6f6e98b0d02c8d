"""Interval, as-of and candidate joins, and the matching of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.operators.scans import scan
from hoptrail.written import materialize

#: Rows of a candidate table that a join may broadcast.
MOST_CANDIDATES = 100_000


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, how: str = "left", bin_width: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Points with the half-open intervals [start, stop) that hold them, within equal values of ``by``.

    Intervals are cut into bins and joined by bin, whatever their number, so both sides are
    shuffled at most once. A bin is as wide as the mean interval unless ``bin_width``
    says otherwise, so an interval has about two bins on average, however long some are.
    """
    if bin_width is None:
        mean = intervals.filter(F.col(stop) > F.col(start)).agg(F.avg(F.col(stop) - F.col(start))).first()[0]
        bin_width = max(1, int(mean or 1))
    width = F.lit(bin_width)
    real = intervals.filter(F.col(stop) > F.col(start))
    binned = real.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    own = points.withColumn("_at", F.floor(F.col(point) / width))
    same = F.col("_at") == F.col("_bin")
    for c in by or []:
        binned = binned.withColumnRenamed(c, f"_{c}")
        same = same & (F.col(c) == F.col(f"_{c}"))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))
    return own.join(binned, same & inside, how).drop("_at", "_bin", *[f"_{c}" for c in by or []])


def best_interval(joined: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """One row for each key: the first by ``priority``."""
    return joined.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*priority))).filter("_n = 1").drop("_n")


def asof_join(probes: DataFrame, builds: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """The latest earlier ``value`` of the same key for each probe, strictly before it; one shuffle on ``by``."""
    left = probes.withColumns({"_side": F.lit(0), "_v": F.lit(None).cast(builds.schema[value].dataType)})
    right = builds.select(*by, at, F.lit(1).alias("_side"), F.col(value).alias("_v"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.last(F.when(F.col("_side") == 1, F.col("_v")), ignorenulls=True).over(w)).filter("_side = 0").drop("_side", "_v")


def next_hint(df: DataFrame, target: str, start: str, by: list[str], order: list[str]) -> DataFrame:
    """Whether the row after this one starts where this one goes."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("next_start", F.lead(start).over(w)).withColumn("hint_matches", F.coalesce(F.col(target) == F.col("next_start"), F.lit(False)))


def best_candidate(points: DataFrame, candidates: DataFrame, allowed: Column, score: Column, keys: list[str], rank: str) -> DataFrame:
    """The candidate of the highest score for each point; the smaller ``rank`` on ties.

    ``allowed`` may be any condition, so each point meets each candidate: they are broadcast,
    and more than ``MOST_CANDIDATES`` are an error. Candidates that lie in intervals are found by ``interval_join``.
    """
    held = materialize(candidates, "candidates")
    if held.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates")
    scored = points.join(F.broadcast(held), allowed).withColumn("score", score)
    return best_interval(scored, keys, [F.desc("score"), F.col(rank)])


def unique_pairs(old: DataFrame, new: DataFrame, keys: list[str], old_id: str, new_id: str) -> DataFrame:
    """Pairs of rows that share a key which either side has once."""

    def once(df: DataFrame, name: str) -> DataFrame:
        full = df.dropna(subset=keys)
        return full.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(name).alias(name)).filter("_n = 1").drop("_n")

    return once(old, old_id).join(once(new, new_id), keys)


def match_versions(old: DataFrame, new: DataFrame, name: str, signature: str, old_id: str, new_id: str) -> DataFrame:
    """Pairs of two versions' functions with method and confidence.

    Unique names first, then within a name unique signatures, then the single one left on both sides.
    """
    by_name = unique_pairs(old, new, [name], old_id, new_id).select(old_id, new_id, F.lit("name").alias("method"), F.lit("high").alias("confidence"))
    rest_old, rest_new = old.join(by_name, old_id, "left_anti"), new.join(by_name, new_id, "left_anti")
    signed = unique_pairs(rest_old.filter(F.col(signature) != ""), rest_new.filter(F.col(signature) != ""), [name, signature], old_id, new_id).select(old_id, new_id, F.lit("signature").alias("method"), F.lit("high").alias("confidence"))
    rest_old, rest_new = rest_old.join(signed, old_id, "left_anti"), rest_new.join(signed, new_id, "left_anti")
    single = unique_pairs(rest_old, rest_new, [name], old_id, new_id).select(old_id, new_id, F.lit("residual").alias("method"), F.lit("medium").alias("confidence"))
    return by_name.unionByName(signed).unionByName(single)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, type) with each one's reverse; the direction is part of the type."""
    out = edges.select("src", "dst", F.concat(F.lit("out:"), "type").alias("type"))
    return out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("in:"), "type").alias("type")))


def propagate(mapping: DataFrame, old_edges: DataFrame, new_edges: DataFrame, rounds: int | None = None, named: bool = False) -> DataFrame:
    """Mapped pairs (o, n) grown along edges (src, dst, type): successors that are unique of their type on both sides.

    Without ``rounds`` it goes on until a round adds no pair; a round then writes its
    pairs and the edges that mapped nodes have to unmapped ones. With ``named`` each pair has
    ``how``, the greatest type of the edges that led to it, null for given ones.
    """

    def free(edges: DataFrame, done: DataFrame, own: str) -> DataFrame:
        return edges.join(done.select(F.col(own).alias("dst")), "dst", "left_anti")

    def step(edges: DataFrame, done: DataFrame, own: str, other: str) -> DataFrame:
        return edges.join(done.select("o", "n"), F.col("src") == F.col(own)).groupBy("o", "n", "type").agg(F.count("*").alias("_c"), F.min("dst").alias(other)).filter("_c = 1").drop("_c")

    def chosen(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.join(new, ["o", "n", "type"]).groupBy("o2", "n2").agg(F.max("type").alias("how"))
        sole = both.withColumns({"_a": F.count("*").over(Window.partitionBy("o2")), "_b": F.count("*").over(Window.partitionBy("n2"))}).filter("_a = 1 AND _b = 1")
        return sole.select(F.col("o2").alias("o"), F.col("n2").alias("n"), "how")

    mapping = mapping.withColumn("how", F.lit(None).cast("string"))
    columns = ["o", "n", "how"] if named else ["o", "n"]
    if rounds is not None:
        for _ in range(rounds):
            mapping = mapping.unionByName(chosen(step(free(old_edges, mapping, "o"), mapping, "o", "o2"), step(free(new_edges, mapping, "n"), mapping, "n", "n2")))
        return mapping.select(*columns)
    done = last = materialize(mapping, "pairs")
    sides = [_Reach(old_edges, "o", "o2"), _Reach(new_edges, "n", "n2")]
    while n := last.count():
        both = [side.after(last, n) for side in sides]
        last = materialize(chosen(*both), "pairs")
        done = done.unionByName(last)
    return done.select(*columns)


#: An edge table is written again when a round's pairs are at least this part of it.
REWRITE = 1 / 32


class _Reach:
    """One side's edges from mapped to unmapped nodes, kept from round to round.

    ``rest`` has the edges whose source isn't mapped. It is written again only when a good part of it
    changes, so all its writings together are a multiple of the first; else a round costs what its pairs reach.
    """

    def __init__(self, edges: DataFrame, own: str, other: str):
        self.rest, self.rows, self.own, self.other = edges, 0, own, other
        self.open = self.since = None  # edges (o, n, type, dst) found so far; nodes mapped since rest was written

    def after(self, last: DataFrame, n: int) -> DataFrame:
        """o, n, type and the one unmapped node there, when ``last`` (n pairs) is mapped too."""
        pairs, nodes = last.select("o", "n"), last.select(F.col(self.own).alias("dst"))
        self.since = nodes if self.since is None else self.since.unionByName(nodes)
        at = F.col("src") == F.col(self.own)
        if n >= self.rows * REWRITE:
            told = materialize(self.rest.join(self.since, "dst", "left_anti").join(pairs, at, "left"), "edges")
            self.rest, found = told.filter(F.col(self.own).isNull()).select("src", "dst", "type"), told.filter(F.col(self.own).isNotNull())
            self.rows, self.since = self.rest.count(), None
        else:
            found = self.rest.join(pairs, at).join(self.since, "dst", "left_anti")
        found = found.select("o", "n", "type", "dst")
        if self.open is None:
            self.open = found  # of the table just written
        else:
            self.open = materialize(self.open.join(nodes, "dst", "left_anti").unionByName(found), "open")
        return self.open.groupBy("o", "n", "type").agg(F.count("*").alias("_c"), F.min("dst").alias(self.other)).filter("_c = 1").drop("_c")


def mutual_best(pairs: DataFrame, least: float, margin: float) -> DataFrame:
    """Pairs (o, n, similarity) that are each other's best, by a margin over the next one."""

    def best(own: str, other: str) -> DataFrame:
        w = Window.partitionBy(own).orderBy(F.desc("similarity"), other)
        ranked = pairs.withColumns({"_k": F.row_number().over(w), "_next": F.coalesce(F.lead("similarity").over(w), F.lit(0.0))})
        return ranked.filter((F.col("_k") == 1) & (F.col("similarity") >= least) & (F.col("similarity") - F.col("_next") >= margin)).select("o", "n", "similarity")

    return best("o", "n").join(best("n", "o").select("o", "n"), ["o", "n"])


def edge_diff(old: DataFrame, new: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """UNCHANGED, TYPE_CHANGED, REMOVED or ADDED for each edge of two versions with unique keys."""
    a, b = old.select(*keys, F.col(kind).alias("old_type")), new.select(*keys, F.col(kind).alias("new_type"))
    status = F.when(F.col("old_type").isNull(), "ADDED").when(F.col("new_type").isNull(), "REMOVED").when(F.col("old_type") == F.col("new_type"), "UNCHANGED").otherwise("TYPE_CHANGED")
    return a.join(b, keys, "full_outer").withColumn("status", status)


#: Kinds of symbols that are code (public ELF format).
FUNCTIONS = (2, 10)


def symbol_lookup(points: DataFrame, symbols: DataFrame, module: str = "module", at: str = "elf_va", near: int = 8, span: int = 1 << 22) -> DataFrame:
    """``points`` with symbol, symbol_offset and symbol_contains: the symbol at or before each address of its module.

    ``symbols`` has module, name, addr, size and kind (a number; ``FUNCTIONS`` come first). Of the ``near`` + 1
    symbols that end at the last one not after an address, one that holds it wins: a function, then the
    smaller, then the later; a symbol of size 0 holds its own address, as the largest. Without any, the nearest
    before counts. Each distinct address is looked up once, in blocks of ``span`` addresses, and goes
    back to its rows by a join.
    """
    ordered_ = Window.partitionBy(module).orderBy("addr", F.desc("size"), "name").rowsBetween(-near, 0)
    entry = F.struct("name", "addr", "size", "kind")
    place = F.row_number().over(Window.partitionBy(module).orderBy("addr", F.desc("size"), "name"))
    listed = symbols.select(F.col(module).alias("_m"), F.col("addr").alias("_a"), place.alias("_i"), F.collect_list(entry).over(ordered_).alias("_near"))
    # At an address of several symbols the last one's list counts.
    builds = listed.groupBy("_m", "_a").agg(F.max_by("_near", "_i").alias("_near")).select("_m", (F.col("_a") * 2).alias("_k"), F.lit(None).cast("bigint").alias("_va"), "_near")
    probes = points.select(F.col(module).alias("_m"), F.col(at).cast("bigint").alias("_va")).filter("_m IS NOT NULL AND _va IS NOT NULL").distinct()
    both = probes.select("_m", (F.col("_va") * 2 + 1).alias("_k"), "_va", F.lit(None).cast(builds.schema["_near"].dataType).alias("_near")).unionByName(builds)
    placed = scan(both, ["_m"], "_k", fills={"_before": F.col("_near")}, block=2 * span).filter("_va IS NOT NULL")
    va = F.col("_va")
    holds = F.filter("_before", lambda s: F.when(s["size"] > 0, (va >= s["addr"]) & (va < s["addr"] + s["size"])).otherwise(va == s["addr"]))
    ranked = F.array_min(F.transform(holds, lambda s: F.struct(F.when(s["kind"].isin(*FUNCTIONS), 0).otherwise(1).alias("a"), F.when(s["size"] > 0, s["size"]).otherwise(F.lit(1 << 62)).alias("b"), (-s["addr"]).alias("c"), s["name"].alias("name"), s["addr"].alias("addr"))))
    last = F.element_at(F.transform("_before", lambda s: s["addr"]), -1)
    first = F.get(F.filter("_before", lambda s: s["addr"] == last), F.lit(0))  # of several at the nearest address the first
    found = placed.select("_m", "_va", ranked.alias("_hold"), F.when(F.col("_before").isNotNull(), first).alias("_first"))
    found = found.select("_m", "_va", F.coalesce("_hold.name", "_first.name").alias("symbol"), (va - F.coalesce("_hold.addr", "_first.addr")).alias("symbol_offset"), F.col("_hold").isNotNull().alias("symbol_contains"))
    own = points.drop("symbol", "symbol_offset", "symbol_contains")
    out = own.join(found, (F.col(module) == F.col("_m")) & (F.col(at) == F.col("_va")), "left").drop("_m", "_va")
    return out.withColumn("symbol_contains", F.coalesce("symbol_contains", F.lit(False)))


def merged_ranges(ranges: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """Disjoint half-open ranges that cover the same places as those of each key, touching ones joined."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.filter(F.col(start) < F.col(stop)).withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("bigint"))
    numbered_ = marked.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered_.groupBy(*by, "_no").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_no")


def containing(points: DataFrame, bodies: DataFrame, key: list[str], point: str, owner: str, start: str, stop: str, by: list[str] | None = None) -> DataFrame:
    """``points``, unique by ``key``, with the owner whose body, a set of ranges, holds each; the smallest owner of several; null without one.

    Each distinct address is looked up once, its owners are a minimum that tasks combine before
    they shuffle, and it goes back to its rows by a join.
    """
    at = [*(by or []), point]
    whole = merged_ranges(bodies.select(*(by or []), owner, start, stop), [*(by or []), owner], start, stop)
    held = interval_join(points.select(*at).dropna().distinct(), whole, point, start, stop, how="inner", by=by)
    return points.join(held.groupBy(*at).agg(F.min(owner).alias(owner)), at, "left").select(*points.columns, owner)
