"""Secrets: known forms, and candidate strings of high entropy in some window.

Candidates are runs of characters of one class (``CLASSES``). A window slides
over each; the entropy of its characters follows from a sum of c * log2(c) over
the counts c, and a step changes just the counts of the character that leaves
and the one that enters, so nothing is counted anew. A candidate with a window
of at least the class's entropy is reported, unless an allow-list says that
such strings are no secrets. All of it is built-in expressions.

Defined cases: a null text is empty; a text without spans gets the empty list;
extra columns pass through and result columns replace columns of the same name;
repeated rows get repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.spans import spans_text, with_spans

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ["assign", "access", "hex", "entropy"]
#: Class, its candidates, window, least entropy in bits, and what its candidates must hold.
CLASSES = [
    ("base64", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{24,}+", 24, 4.0, r"^(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])(?=[^0-9]*+[0-9])"),
    ("upper", r"(?<![A-Za-z0-9+/=_-])[A-Z0-9]{24,}+(?![A-Za-z0-9+/=_-])", 24, 3.6, r"^(?=[^A-Z]*+[A-Z])(?=[^0-9]*+[0-9])"),
]
#: Strings that look random but are not secret.
ALLOWED = [
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^(?:[A-Z]?+[a-z]++[-_/]?+)++[0-9]{0,4}$",
    r"^sha(?:1|256|384|512)-",
    r"/[a-z]++/|^[-=_+/]|[-=_]{4}",
]


def window_entropy(text: Column, width: int) -> Column:
    """The greatest Shannon entropy, in bits, of the windows of ``width`` characters of a text.

    The fold holds the window's counts as a map and the sum of c * log2(c).
    """
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    steps = F.zip_with(chars, F.concat(F.array_repeat(F.lit("").cast("string"), width), chars), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    zero = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))

    def add(counts: Column, key: Column, by: float) -> Column:
        now = F.coalesce(counts[key], F.lit(0.0)) + by
        return F.map_concat(F.map_filter(counts, lambda k, v: k != key), F.map_from_arrays(F.array(key), F.array(now)))

    def step(s: Column, x: Column) -> Column:
        leaves = s["n"] >= width
        gone = F.coalesce(F.when(leaves, s["counts"][x["old"]]), F.lit(0.0))
        counts = F.when(leaves, add(s["counts"], x["old"], -1.0)).otherwise(s["counts"])
        less = s["sum"] - term(gone) + F.when(gone > 0, term(gone - 1)).otherwise(F.lit(0.0))
        has = F.coalesce(F.when(leaves & (x["new"] == x["old"]), gone - 1).otherwise(s["counts"][x["new"]]), F.lit(0.0))
        total = less - term(has) + term(has + 1)
        full = s["n"] + 1 >= width
        entropy = F.lit(float(width)) * 0 + F.log2(F.lit(float(width))) - total / width
        return F.struct(add(counts, x["new"], 1.0).alias("counts"), total.alias("sum"), F.when(full, F.greatest(s["best"], entropy)).otherwise(s["best"]).alias("best"), (s["n"] + 1).alias("n"))

    return F.aggregate(F.filter(steps, lambda x: x["new"].isNotNull()), zero, step, lambda s: s["best"])


def _allowed(text: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | text.rlike(pattern)
    return out


def _random(spans: Column, width: int, least: float, holds: str) -> Column:
    """The candidates that aren't allowed and have a window of enough entropy."""
    sure = F.filter(spans, lambda s: s["text"].rlike(holds) & ~_allowed(s["text"]))
    return F.filter(sure, lambda s: window_entropy(s["text"], width) >= least)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column of spans (start, stop, text) for each of ``KINDS``."""
    own = [c for c in docs.columns if c not in KINDS]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))  # no name of the input can clash
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text")))
    df = with_spans(df.withColumn("_seen", F.when(F.col("_text").rlike("[:=]"), F.col("_text")).otherwise(F.lit(""))), "_seen", ASSIGN, "assign", groups=(2,))
    df = df.withColumn("assign", plain(F.filter("assign", lambda s: F.char_length(s["g2"]) >= 8)))
    df = with_spans(df.withColumn("_seen", F.when(F.col("_text").contains("AKIA"), F.col("_text")).otherwise(F.lit(""))), "_seen", ACCESS, "access")
    df = df.withColumn("access", plain(F.filter("access", lambda s: F.char_length(s["text"]) >= 16)))
    df = with_spans(df, "_text", HEX, "hex").withColumn("hex", plain(F.col("hex")))
    parts = []
    for name, pattern, width, least, holds in CLASSES:
        df = with_spans(df, "_text", pattern, f"_{name}")
        df = df.withColumn(f"_{name}", plain(_random(F.col(f"_{name}"), width, least, holds)))
        parts.append(F.col(f"_{name}"))
    df = df.withColumn("entropy", F.array_distinct(F.concat(*parts)))
    return df.select(*[F.col("_row")[c].alias(c) for c in own], *KINDS)


def all_spans(kinds: list[str]) -> Column:
    return spans_text([(k, F.col(k)) for k in kinds])
