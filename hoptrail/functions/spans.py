"""Places of all matches of a regular expression, from built-in functions alone.

Spark has no function that gives the places of all matches. A text split by a
pattern and the matches themselves alternate, so running sums of their lengths
in code points are the starts and ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.arrays import running_sums

SPAN = "array<struct<start:bigint,stop:bigint,text:string,before:string,after:string>>"


def with_spans(df: DataFrame, text_col: str, pattern: str, out_col: str, context: int = 0, groups: tuple[int, ...] = ()) -> DataFrame:
    """``df`` with ``out_col``: leftmost non-overlapping matches as structs.

    start and stop are code points, stop exclusive; text is the match; before and
    after hold up to ``context`` characters around it, at most as far as the
    fourth match before or after; g1, g2, ... are the asked groups. The pattern must not match nothing.
    """
    q = F.lit(pattern)
    found, cut = f"_{out_col}_found", f"_{out_col}_cut"
    df = df.withColumn(found, F.regexp_extract_all(text_col, q, F.lit(0)))
    for g in groups:
        df = df.withColumn(f"{found}{g}", F.when(F.size(found) > 0, F.regexp_extract_all(text_col, q, F.lit(g))))
    df = df.withColumn(cut, F.when(F.size(found) > 0, F.split(text_col, pattern, -1)))
    gaps = F.slice(cut, 1, F.size(found))
    steps = F.zip_with(gaps, found, lambda gap, m: (F.char_length(gap) + F.char_length(m)).cast("bigint"))
    ends = f"_{out_col}_ends"
    df = df.withColumn(ends, F.when(F.size(found) > 0, running_sums(steps)))
    # Around a match stand the gaps and the matches next to it, in turn.
    if context:
        around = lambda i, steps: F.concat_ws("", *[F.get(found if odd else cut, i + j) for j, odd in steps])
        after = F.transform(found, lambda x, i: F.left(around(i, [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0)]), F.lit(context)))
        before = F.transform(found, lambda x, i: F.right(around(i, [(-3, 0), (-3, 1), (-2, 0), (-2, 1), (-1, 0), (-1, 1), (0, 0)]), F.lit(context)))
    else:
        before = after = F.transform(found, lambda x: F.lit(""))
    parts = [F.col(found).alias("text"), F.col(ends).alias("stop"), before.alias("before"), after.alias("after")] + [F.col(f"{found}{g}").alias(f"g{g}") for g in groups]
    spans = F.transform(
        F.arrays_zip(*parts),
        lambda x: F.struct(
            (x["stop"] - F.char_length(x["text"])).cast("bigint").alias("start"),
            x["stop"].cast("bigint").alias("stop"),
            x["text"].alias("text"),
            x["before"].alias("before"),
            x["after"].alias("after"),
            *[x[f"g{g}"].alias(f"g{g}") for g in groups],
        ),
    )
    kind = SPAN[:-2] + "".join(f",g{g}:string" for g in groups) + ">>"
    return df.withColumn(out_col, F.when(F.size(found) > 0, spans).otherwise(F.array().cast(kind))).drop(found, cut, ends, *[f"{found}{g}" for g in groups])


def spans_text(kinds: list[tuple[str, Column]], field: str = "stop") -> Column:
    """``kind:start:stop`` of all spans, by start, then in the order of ``kinds``, joined by commas; or another field in place of stop."""

    def rows(place: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("i"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s[field].cast("string")).alias("t")))

    every = F.concat(*[rows(i, kind, spans) for i, (kind, spans) in enumerate(kinds)])
    return F.array_join(F.transform(F.sort_array(every), lambda r: r["t"]), ",")
