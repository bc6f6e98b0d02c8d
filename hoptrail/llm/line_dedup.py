"""Line dedup over a corpus by a deletion-neighbourhood join.

A line is dropped when an earlier line of the corpus equals it or lies within
the edit bound; earlier means a smaller (doc_id, row, line number). The bound is
part of the contract: two lines of at least ``near_chars`` characters may differ
by one edit (insertion, deletion or substitution of a character), shorter ones
not at all, for one edit makes another word of a short line. Lines without a
word are never dropped.

1. Lines are compared by 128-bit hashes; equal lines are one class.
2. A class can have a partner within one edit only if another class equals it
   outside one of ``parts`` segments. Two rounds of such keys, halves without
   texts and then sixteenths, leave few suspects; none that has a partner is lost.
   Keys are aggregated to the least and greatest class before any join, so that a
   half that many lines share is one row a task.
3. Suspects emit all deletion variants within those segments as hashed keys; the
   segment's key is part of a variant's. Two lines that differ in one place share
   the variant with that place deleted, so each is joined to the earliest of its
   variant and place; a line that lacks one character equals a variant of the
   other. Both joins give at most one partner a variant.
4. Levenshtein's distance confirms each pair.

A variant's hash is a sum of hashes of (character, place), so all variants of a
line come from running sums, in time linear in its length.

Only built-in functions are used. Defined cases: a null text stays null and has
no lines; rows equal in doc_id and text are one document, and lose the same
lines; a null doc_id comes first; extra columns pass through, and n_lines and
n_dropped replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.arrays import running_sums
from hoptrail.functions.fence import fenced
from hoptrail.llm.scratch import looked_up, materialize, release

WORD = r"[^\x20\x09-\x0D]"
CLASS = ["k1", "k2"]


def _segments(line: Column, length: Column, parts: int) -> list[tuple[Column, Column, Column, int]]:
    """Key, first and last place of each segment, and the characters lacking in a partner: 0 for partners as long or longer, 1 for shorter ones.

    The key is a hash of the line without the segment.
    """
    out = []
    for lacks in (0, 1):
        m = length - lacks
        for q in range(parts):
            lo, hi = F.floor(m * q / parts).cast("int"), F.floor(m * (q + 1) / parts).cast("int")
            out.append((F.xxhash64(F.lit(q), m, F.left(line, lo), F.right(line, m - hi)), lo, hi, lacks))
    return out


def _in_two_classes(keyed: DataFrame) -> DataFrame:
    """The values of ``key`` that lines of different classes have; of a class, half its hash tells it apart."""
    return keyed.groupBy("key").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo != hi").select("key")


def _variants(texts: DataFrame) -> DataFrame:
    """k1, k2, first, and for each place of each of a line's ``spots`` the spot's key and lacks, the place, and the hash of the line without its character; place -1: the whole line."""
    mask = (1 << 40) - 1  # sums of up to 2 ** 23 such numbers fit a long
    chars = texts.withColumn("chars", fenced(F.filter(F.split("line", ""), lambda c: c != "")))
    hashed = chars.select(*CLASS, "first", "spots", *[fenced(F.transform("chars", lambda c, j: F.xxhash64(c, j - shift).bitwiseAND(F.lit(mask)))).alias(name) for name, shift in (("here", 0), ("moved", 1))])
    # Up to a place as it stands, after it moved by one.
    sums = hashed.select(*CLASS, "first", "spots", fenced(running_sums(F.col("here"))).alias("here"), fenced(running_sums(F.col("moved"))).alias("moved"))
    last = F.size("here") - 1

    def cut(s: Column) -> Column:
        def row(i: Column) -> Column:
            before = F.when(i > 0, F.get("here", i - 1)).otherwise(F.lit(0).cast("bigint"))
            return F.struct(s["key"].alias("key"), s["lacks"].alias("lacks"), i.alias("place"), (before + F.get("moved", last) - F.get("moved", i)).alias("h"))

        return F.transform(F.sequence(s["lo"], F.least(s["hi"], last)), row)

    whole = F.transform(F.filter("spots", lambda s: s["lacks"] == 0), lambda s: F.struct(s["key"].alias("key"), s["lacks"].alias("lacks"), F.lit(-1).alias("place"), F.get("here", last).alias("h")))
    return sums.select(*CLASS, "first", F.inline(F.concat(F.flatten(F.transform("spots", cut)), whole)))


def _suspects(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """k1, k2, line and ``spots`` of the classes that equal another one outside a sixteenth of the line, written."""
    keys = placed.select(*CLASS, F.explode("keys").alias("key"))
    shared = materialize(_in_two_classes(keys), "shared-keys")
    some = materialize(looked_up(keys, shared, ["key"], "left_semi").select(*CLASS).distinct(), "suspects")
    texts = materialize(looked_up(lines.select(*CLASS, "line"), some, CLASS, "left_semi").groupBy(*CLASS).agg(F.first("line").alias("line")), "suspect-lines")
    spots = F.array(*[F.struct(key.alias("key"), lo.alias("lo"), hi.alias("hi"), F.lit(lacks).alias("lacks")) for key, lo, hi, lacks in _segments(F.col("line"), F.char_length("line"), 16)])
    fine = materialize(texts.select(*CLASS, F.inline(spots)), "fine-keys")
    kept = looked_up(fine, materialize(_in_two_classes(fine), "shared-fine"), ["key"], "left_semi").groupBy(*CLASS).agg(F.collect_set(F.struct("key", "lo", "hi", "lacks")).alias("spots"))  # at most 32 a line
    return materialize(texts.join(kept, CLASS), "fine-lines")


def _near(suspects: DataFrame, firsts: DataFrame) -> DataFrame:
    """k1, k2 of the suspects with an earlier one within one edit."""
    texts = materialize(suspects.join(firsts, CLASS), "placed-lines")
    variants = materialize(_variants(texts), "variants")
    replaced, deleted, whole = variants.filter("lacks = 0 AND place >= 0"), variants.filter("lacks = 1"), variants.filter("place < 0")
    earliest = replaced.groupBy("key", "h", "place").agg(F.min("first").alias("other"), F.max("first").alias("last")).filter("other != last").select("key", "h", "place", "other")
    one = replaced.join(earliest, ["key", "h", "place"]).filter("first != other").select(*CLASS, "other")
    longer = deleted.select("key", "h", F.struct("first", *CLASS).alias("a")).distinct().join(whole.select("key", "h", F.struct("first", *CLASS).alias("b")), ["key", "h"])
    two = longer.select(F.greatest("a", "b").alias("late"), F.least("a.first", "b.first").alias("other")).select("late.k1", "late.k2", "other")
    there = one.unionByName(two).distinct().join(texts.select(*CLASS, "line"), CLASS).join(texts.select(F.col("first").alias("other"), F.col("line").alias("earlier")), "other")
    return there.filter(F.levenshtein("line", "earlier", 1).between(0, 1)).select(*CLASS).distinct()


def _dropped(lines: DataFrame, near_chars: int) -> DataFrame:
    """_d, _r and ``gone``, the numbers of the lines that a document loses, written."""
    length = F.char_length("line")
    keys = F.when(length >= near_chars, F.array(*[s[0] for s in _segments(F.col("line"), length, 2)]))
    placed = materialize(lines.select("d", "r", "p", *CLASS, keys.alias("keys")), "lines")
    suspects = _suspects(lines, placed)
    release(lines.sparkSession)
    repeated = placed.groupBy(*CLASS).agg(F.count("*").alias("n")).filter("n > 1").select(*CLASS)
    asked = materialize(repeated.unionByName(suspects.select(*CLASS)).distinct(), "asked")
    found = materialize(looked_up(placed.select("d", "r", "p", *CLASS), asked, CLASS, "inner"), "found")
    firsts = materialize(found.groupBy(*CLASS).agg(F.min(F.struct("d", "r", "p")).alias("first")), "firsts")
    near = _near(suspects, firsts).withColumn("near", F.lit(True))
    marked = materialize(firsts.join(near, CLASS, "left"), "marked")
    gone = looked_up(found, marked, CLASS, "inner").filter(F.col("near").isNotNull() | (F.struct("d", "r", "p") != F.col("first")))
    release(lines.sparkSession)
    return materialize(gone.groupBy(F.col("d").alias("_d"), F.col("r").alias("_r")).agg(F.collect_set("p").alias("gone")), "gone")  # one document's lines


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 20) -> DataFrame:
    """``docs`` with duplicate lines cut from the text, n_lines (of the input) and n_dropped."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(F.lit(7), F.col(f"`{text_col}`")).alias("r"), F.col(f"`{text_col}`").alias("t"))
    lines = marked.select("d", "r", F.posexplode(F.split("t", "\n")).alias("p", "line")).filter(F.col("line").rlike(WORD))
    lines = lines.select("*", F.xxhash64(F.lit(1), "line").alias("k1"), F.xxhash64(F.lit(2), "line").alias("k2"))
    lists = _dropped(lines, near_chars)
    joined = marked.join(lists, (F.col("r") == F.col("_r")) & F.col("d").eqNullSafe(F.col("_d")), "left").withColumn("_lines", F.split("t", "\n"))
    # Flags in line order, zipped with the lines: linear, with no lookup inside a lambda.
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    flags = F.sort_array(F.concat(F.transform(stay, lambda i: F.struct(i.alias("i"), F.lit(True).alias("f"))), F.transform("gone", lambda i: F.struct(i.alias("i"), F.lit(False).alias("f")))))
    left = F.filter(F.zip_with("_lines", flags, lambda x, f: F.when(f["f"], x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(left, "\n"))
    out = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in own]
    return joined.select(*out, F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), fenced(F.coalesce(F.size("gone"), F.lit(0)).cast("long")).alias("n_dropped"))


def cut_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 20) -> DataFrame:
    """``docs`` with duplicate lines cut; documents all of whose words stood in such lines are dropped."""
    done = dedup_lines(docs, id_col, text_col, near_chars)
    empty = (F.col("n_dropped") > 0) & ~F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    return done.filter(~empty).select(*[F.col(f"`{c}`") for c in docs.columns])
