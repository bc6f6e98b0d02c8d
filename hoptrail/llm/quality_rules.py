"""Quality rules: base statistics and a learned decision list, all in Spark expressions.

``text_stats`` computes the statistics of every whole text. ``learn`` takes a
bounded sample of labelled rows (``sample_rows``; the rows with the smallest
hashes of their doc_id) and grows rules by sequential covering: a conjunction
of thresholds is grown greedily by information gain on a growing part of the
sample, pruned from its end on a part held back, and kept if what it covers
there is bad often enough; covered rows are removed and the next rule is grown.
``DecisionList.column`` emits the ordered rules as one Spark CASE expression.

Defined cases: a null text has no words; without labels of both kinds there are
no rules and every document that passes the base stays; repeated rows get
repeated results; of contradicting labels of a doc_id the least counts; extra
columns pass through whatever their names, and result columns replace columns of
the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoptrail.functions.fence import fenced

WORD = r"[^\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that rules may test, from the base statistics and the text's length.
FEATURES = ["n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "short_line_ratio"]
_BLANKS, _SYMBOLS = "\t\n\x0b\x0c\r", "#*$%&|<>"


def text_stats(docs: DataFrame, text_col: str = "text", repeat_words: int = 5) -> DataFrame:
    """``docs`` with the base statistics and the features of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [c for c in docs.columns if c not in {*BASE, *FEATURES, "base_failed"}]
    # Plain replacements and a split at one character are several times cheaper than expressions over classes.
    spaced, bare, plain = text, text, text
    for c in _BLANKS:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    for c in _SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    for c in " " + _BLANKS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    size = F.char_length(text)
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),  # no name of the input can clash
        fenced(F.array_remove(F.split(spaced, " "), "")).alias("_words"),
        fenced(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))).alias("_lines"),
        (size - F.char_length(plain)).cast("long").alias("n_symbols"),
        F.char_length(bare).cast("long").alias("word_chars"),
    )
    # Hashes of words, then of windows; a window found twice marks all its words. The fences keep each array
    # a column of its own, so that looking up neighbours in it never computes it again.
    df = df.withColumn("_hashes", fenced(F.transform("_words", lambda w: F.xxhash64(w))))
    n = F.size("_hashes") - (repeat_words - 1)
    windows = F.transform(F.slice("_hashes", 1, F.greatest(n, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("_hashes", i + j) for j in range(1, repeat_words)]))
    df = df.withColumn("_windows", fenced(windows))
    df = df.withColumn("_some", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", fenced(F.when(F.col("_some"), placed)))
    m = F.size("_sorted") - 1
    same = F.zip_with(F.slice("_sorted", 1, m), F.slice("_sorted", 2, m), lambda x, y: x["h"] == y["h"])
    df = df.withColumn("_same", F.when(F.col("_some"), same))
    no = F.array(F.lit(False))
    marked = F.zip_with("_sorted", F.zip_with(F.concat(no, "_same"), F.concat("_same", no), lambda x, y: x | y), lambda w, d: F.when(d, w["i"]))
    df = df.withColumn("_starts", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-repeat_words).alias("to")),
        lambda s, i: F.struct((s["n"] + i + repeat_words - F.greatest(i, s["to"])).alias("n"), (i + repeat_words).alias("to")),
        lambda s: s["n"],
    )
    df = df.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.filter("_lines", lambda x: F.char_length(x) < 30)).alias("_n_short"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = F.col("n_words")
    df = df.select(
        "_row",
        *BASE,
        ((n < 10) | (F.col("n_repeat_words") * 100 > n * 20)).alias("base_failed"),
        ratio(F.col("word_chars"), n).alias("mean_word"),
        ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        ratio(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_repeat_words"), n).alias("repeat_ratio"),
        ratio(F.col("_n_short"), F.col("_n_lines")).alias("short_line_ratio"),
    )
    return df.select(*[F.col("_row")[c].alias(c) for c in own], *BASE, "base_failed", *FEATURES[1:])


@dataclass
class Rule:
    """A conjunction of (feature, is an upper bound, threshold)."""

    tests: list[tuple[str, bool, float]]
    precision: float = 0.0
    covered: int = 0

    def covers(self, row: dict) -> bool:
        return all(row[f] <= t if upper else row[f] > t for f, upper, t in self.tests)

    def column(self) -> Column:
        out = F.lit(True)
        for f, upper, t in self.tests:
            out = out & (F.col(f) <= t if upper else F.col(f) > t)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{f} {'<=' if upper else '>'} {t:.6g}" for f, upper, t in self.tests)


@dataclass
class DecisionList:
    """Ordered rules; a row that a rule covers is bad, all others are good."""

    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """Whether the list keeps a row, as one CASE expression over the features."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
        return F.lit(True) if out is None else out.otherwise(True)


def _information(p: float, n: float) -> float:
    return math.log2((p + 1) / (p + n + 2))


def _best_test(rows: list[dict], features: list[str], candidates: int) -> tuple[float, tuple] | None:
    """The test with the greatest gain in information times bad rows covered."""
    bad = sum(r["bad"] for r in rows)
    before, best = _information(bad, len(rows) - bad), None
    for f in features:
        ordered = sorted(rows, key=lambda r: r[f])
        step, p = max(1, len(ordered) // candidates), 0
        for k, r in enumerate(ordered[:-1]):
            p += r["bad"]
            if (k + 1) % step and k + 2 < len(ordered) or ordered[k + 1][f] == r[f]:
                continue
            cut = (r[f] + ordered[k + 1][f]) / 2
            for upper, q, n in ((True, p, k + 1 - p), (False, bad - p, len(ordered) - k - 1 - (bad - p))):
                gain = q * (_information(q, n) - before)
                if q and (best is None or gain > best[0]):
                    best = (gain, (f, upper, cut))
    return best


def cover(rows: list[dict], features: list[str] = FEATURES, most_rules: int = 12, most_tests: int = 4, least_precision: float = 0.95, least_covered: int = 5, candidates: int = 200) -> DecisionList:
    """Sequential covering: grow on two thirds of the rows, prune and judge on the rest."""
    grow, prune, out = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0], DecisionList()
    while len(out.rules) < most_rules and any(r["bad"] for r in grow):
        tests, left = [], grow
        while len(tests) < most_tests and any(not r["bad"] for r in left):
            found = _best_test(left, features, candidates)
            if not found or found[0] <= 0:
                break
            tests.append(found[1])
            left = [r for r in left if Rule([found[1]]).covers(r)]
        best = None
        for n in range(len(tests), 0, -1):  # shorter rules from the end on
            rule = Rule(tests[:n])
            held = [r["bad"] for r in prune if rule.covers(r)]
            value = (2 * sum(held) - len(held)) / max(1, len(held))
            if best is None or value >= best[0]:
                best = (value, rule, held)
        if not best or len(best[2]) < least_covered or sum(best[2]) < least_precision * len(best[2]):
            break
        rule = best[1]
        rule.precision, rule.covered = sum(best[2]) / len(best[2]), len(best[2])
        out.rules.append(rule)
        grow, prune = [r for r in grow if not rule.covers(r)], [r for r in prune if not rule.covers(r)]
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6_000, **how) -> DecisionList:
    """A decision list from at most ``sample_rows`` labelled documents that pass the base rules."""
    # Of labels that contradict each other the worse one counts.
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna().groupBy("_id").agg(F.min("_label").alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    held = sample.collect()  # sample_rows bounds it
    if len({r["_label"] > 0 for r in held}) < 2:
        return DecisionList()
    kind = known.schema["_id"].dataType.simpleString()  # ids may be numbers or texts
    chosen = docs.sparkSession.createDataFrame([(r["_id"], 1 - int(r["_label"] > 0)) for r in held], f"_id {kind}, bad int")
    own = docs.select(F.col(id_col).cast(kind).alias("_key"), F.col(text_col).alias("text"))
    stats = text_stats(own.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_id", "bad", "text"))
    # No filter here: pushed down, it would copy the nested array expressions. The sample bounds the rows.
    rows = stats.select("_id", "bad", "base_failed", *FEATURES).orderBy(F.xxhash64("_id"), *FEATURES).limit(2 * sample_rows).collect()
    return cover([{**{f: float(r[f]) for f in FEATURES}, "bad": r["bad"]} for r in rows if not r["base_failed"]], **how)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` with statistics, base_failed and ``kept``."""
    stats = text_stats(docs.drop("kept"), text_col)
    return stats.withColumn("kept", fenced(~F.col("base_failed") & rules.column()))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that base rules and the learned list keep, with their own columns."""
    rules = learn(docs, labels, id_col, text_col, **how)
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return judge(bare, rules, "_text").filter("kept").select("_row.*")
