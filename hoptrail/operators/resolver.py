"""Runtime addresses to modules, file addresses and reasons, by interval joins.

``maps``: map_idx, start, stop, perms, pgoff, path. ``rules``: what ``traces.module_rules``
gives. ``segments``: elf, seg_idx, p_offset, p_vaddr, p_filesz, p_memsz, flags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.literals import align_down, align_up, file_offset, permission_compatible, permission_text
from hoptrail.functions.text import base_name
from hoptrail.operators.joins import best_interval, interval_join, symbol_lookup
from hoptrail.operators.windows import numbered
from hoptrail.written import materialize

#: Reasons of addresses without a module.
NO_MAP, NOT_EXECUTABLE, NO_MODULE = "address-not-in-maps", "address-in-non-executable-map", "no-configured-elf"
#: What speaks for a candidate.
BASE, MAPPED, MAP_EXECUTES, ALIAS, COMPATIBLE, RANGES, CONTEXTS, LEVELS = 100, 30, 30, 100, 20, 100, 50, 30
#: What speaks for a load bias, and against it.
ANCHOR, NAME, OFFSET, SIZE, PART, EXECUTES, COVERS, COVERS_CODE, MOST_LOSS = 1000, 300, 200, 400, 80, 150, 10, 30, 300


def allowed(ids: Column, value: Column) -> Column:
    """Whether a list of ids has a value; a null list allows all, null values too."""
    return ids.isNull() | F.coalesce(F.array_contains(ids, value), F.lit(False))


def context_matches(context_id: Column, vmid: Column, el: Column) -> Column:
    """Whether a rule (context_ids, vmids, els) takes part in a context."""
    return allowed(F.col("context_ids"), context_id) & allowed(F.col("vmids"), vmid) & allowed(F.col("els"), el)


def range_matches(address: Column) -> Column:
    """Whether one of a rule's ``ranges`` holds an address; a rule without ranges takes all."""
    return (F.coalesce(F.size("ranges"), F.lit(0)) == 0) | F.exists("ranges", lambda r: (address >= r["start"]) & (address < r["stop"]))


def alias_matches(path: Column) -> Column:
    """Whether one of a rule's ``anchors`` is found in a map's path."""
    return F.coalesce(F.exists("anchors", lambda p: F.regexp_like(path, p)), F.lit(False))


def find_maps(points: DataFrame, maps: DataFrame, key: str, address: str) -> DataFrame:
    """``points`` with the map of each: the one that starts last of those that hold it; null without one."""
    named = maps.select("map_idx", F.col("start").alias("map_start"), F.col("stop").alias("map_stop"), "perms", "pgoff", "path")
    return best_interval(interval_join(points, named, address, "map_start", "map_stop"), [key], [F.desc("map_start"), F.col("map_idx")])


def resolve(points: DataFrame, maps: DataFrame, rules: DataFrame, segments: DataFrame, key: str = "row_id", address: str = "address") -> DataFrame:
    """``points`` (key, address, context_id, vmid, el) with path, module, elf, elf_va, file_offset, seg_idx and reason.

    A module's executable segments at its bias are intervals of runtime addresses;
    an address meets the few that hold it, and the one of the highest score wins,
    rules and segments in their order on ties. What the lookup reads (address and context) is
    looked up once where points share it, and goes back to them by a join.
    """
    asked = [address, "context_id", "vmid", "el"]
    sought = materialize(numbered(points.select(*asked).distinct(), asked, "_ask"), "asked")
    found = _resolved(sought, maps, rules, segments, "_ask", address).drop("_ask").withColumnsRenamed({c: f"_{c}" for c in asked})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked])
    return points.join(found, same, "left").drop(*[f"_{c}" for c in asked])


def _resolved(points: DataFrame, maps: DataFrame, rules: DataFrame, segments: DataFrame, key: str, address: str) -> DataFrame:
    own = points.columns
    mapped = materialize(find_maps(points, maps, key, address), "mapped")
    code = rules.filter(F.col("load_bias").isNotNull()).join(segments.filter(F.col("flags").bitwiseAND(1) != 0), "elf")
    at = code.withColumn("_start", F.col("p_vaddr") + F.col("load_bias")).withColumn("_stop", F.col("_start") + F.col("p_memsz"))
    open_ = mapped.filter(F.col("perms").isNull() | F.col("perms").contains("x"))
    found = interval_join(open_, at, address, "_start", "_stop", "inner").filter(context_matches(F.col("context_id"), F.col("vmid"), F.col("el")) & range_matches(F.col(address)))
    has, points_for = F.col("path").isNotNull(), lambda c, n: F.when(c, n).otherwise(0)
    score = (
        F.lit(BASE)
        + points_for(has, MAPPED)
        + points_for(has & F.col("perms").contains("x"), MAP_EXECUTES)
        + points_for(has & alias_matches(F.col("path")), ALIAS)
        + points_for(has & permission_compatible(F.col("perms"), permission_text(F.col("flags"))), COMPATIBLE)
        + points_for(F.coalesce(F.size("ranges"), F.lit(0)) > 0, RANGES)
        + points_for(F.col("context_ids").isNotNull(), CONTEXTS)
        + points_for(F.col("els").isNotNull(), LEVELS)
    )
    best = best_interval(found.withColumn("score", score), [key], [F.desc("score"), F.col("module_idx"), F.col("seg_idx")])
    va = F.col(address) - F.col("load_bias")
    best = best.select(key, F.col("name").alias("module"), "elf", va.alias("elf_va"), file_offset(va, F.col("p_vaddr"), F.col("p_offset"), F.col("p_filesz")).alias("file_offset"), "seg_idx", "score")
    reason = F.when(F.col("path").isNotNull() & ~F.col("perms").contains("x"), NOT_EXECUTABLE).when(F.col("module").isNotNull(), None).when(F.col("path").isNull(), NO_MAP).otherwise(NO_MODULE)
    return mapped.join(best, key, "left").select(*own, "path", "module", "elf", "elf_va", "file_offset", "seg_idx", "score", reason.alias("reason"))


def infer_bias(rules: DataFrame, maps: DataFrame, segments: DataFrame, page: int = 4096) -> DataFrame:
    """module_idx, load_bias and score of the best placement of each rule's file; rules that fit no map have no row.

    A process has some thousand maps, and a file some segments: candidates are their pairs.
    """
    pairs = rules.join(segments, "elf").crossJoin(maps)  # configuration tables
    anchor, by_name = alias_matches(F.col("path")), F.lower(base_name(F.col("path"))).contains(F.lower("name"))
    pairs = pairs.withColumn("anchor", anchor).filter((F.size("anchors") == 0) | F.col("anchor"))
    pairs = pairs.filter(permission_compatible(F.col("perms"), permission_text(F.col("flags"))))
    vaddr, offset, size = align_down(F.col("p_vaddr"), page), align_down(F.col("p_offset"), page), F.col("stop") - F.col("start")
    runs = align_up(F.col("p_vaddr") - vaddr + F.col("p_memsz"), page)
    same_exec = F.col("perms").contains("x") == (F.col("flags").bitwiseAND(1) != 0)
    score = (
        F.when(F.col("anchor"), ANCHOR).otherwise(0)
        + F.when(by_name, NAME).otherwise(0)
        + F.when(F.col("pgoff") == offset, OFFSET).when(F.col("pgoff") != 0, -OFFSET).otherwise(0)
        + F.when(size == runs, SIZE).when(size <= runs, PART).otherwise(-F.least(F.lit(MOST_LOSS), F.floor((size - runs) / page)))
        + F.when(same_exec, EXECUTES).otherwise(0)
    )
    scored = materialize(pairs.select("module_idx", "elf", "map_idx", "seg_idx", (F.col("start") - vaddr).alias("load_bias"), score.cast("long").alias("own")), "biases")
    # How many maps start in some segment of the file at a bias, and how many of those execute on both sides.
    placed = scored.select("module_idx", "elf", "load_bias").distinct().join(segments, "elf").select("module_idx", "load_bias", "seg_idx", "flags", (F.col("p_vaddr") + F.col("load_bias")).alias("_lo"), (F.col("p_vaddr") + F.col("p_memsz") + F.col("load_bias")).alias("_hi"))
    hits = interval_join(maps.select("map_idx", "start", "perms"), placed, "start", "_lo", "_hi", "inner")
    first = hits.groupBy("module_idx", "load_bias", "map_idx", "perms").agg(F.min_by("flags", "seg_idx").alias("flags"))
    both = F.col("perms").contains("x") & (F.col("flags").bitwiseAND(1) != 0)
    covered = first.groupBy("module_idx", "load_bias").agg((F.count("*") * COVERS + F.count_if(both) * COVERS_CODE).alias("covers"))
    total = scored.join(covered, ["module_idx", "load_bias"], "left").withColumn("score", F.col("own") + F.coalesce("covers", F.lit(0)))
    return best_interval(total, ["module_idx"], [F.desc("score"), F.abs("load_bias"), F.col("map_idx"), F.col("seg_idx")]).select("module_idx", "load_bias", "score")


def with_bias(rules: DataFrame, inferred: DataFrame) -> DataFrame:
    """Rules whose bias is given, or inferred where it isn't."""
    found = inferred.select("module_idx", F.col("load_bias").alias("_bias"))
    return rules.join(found, "module_idx", "left").withColumn("load_bias", F.coalesce("load_bias", "_bias")).drop("_bias")


NO_BYTES = "elf-bytes-unavailable"


def described(resolved: DataFrame, symbols: DataFrame, sections: DataFrame, words: DataFrame, key: str = "row_id") -> DataFrame:
    """The result of ``resolve`` with the symbol, section and instruction word of each address.

    ``symbols`` (elf, name, addr, size, kind), ``sections`` (elf, name, addr, size) and ``words`` (elf, va, word) come
    from the files; an address that resolves but has no word gets the reason ``NO_BYTES``.
    """
    held = materialize(symbol_lookup(resolved, symbols, module="elf"), "symbols")
    spans = sections.filter("size > 0").select("elf", F.col("name").alias("section"), F.col("addr").alias("_a"), (F.col("addr") + F.col("size")).alias("_b"))
    placed = best_interval(interval_join(held, spans, "elf_va", "_a", "_b", by=["elf"]), [key], [F.desc("_a"), F.asc(F.col("_b"))]).drop("_a", "_b")
    read = words.select(F.col("elf").alias("_e"), F.col("va").alias("_va"), "word")
    out = placed.join(read, (F.col("elf") == F.col("_e")) & (F.col("elf_va") == F.col("_va")), "left").drop("_e", "_va")
    return out.withColumn("reason", F.when(F.col("reason").isNull() & F.col("elf_va").isNotNull() & F.col("word").isNull(), NO_BYTES).otherwise(F.col("reason")))
