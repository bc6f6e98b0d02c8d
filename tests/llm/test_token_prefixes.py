"""Budgets and truncation answered from the table of the registered query, against the library."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_token_counts import PATH, library, texts  # noqa: F401

from hoptrail.llm import token_counts


@pytest.mark.parametrize("budget", [0, 5])
def test_production_table(spark, library, budget):  # noqa: F811
    rows = [(t,) for t in [*texts(), "noblanks" * 30, "a b <|endoftext|> c d", "x  y\n z 's don't"]]
    out = token_counts.prefix_table(spark.createDataFrame(rows, "text string"), PATH, P.PATTERN)
    ask = [token_counts.tokens_within(c).alias(f"w{c}") for c in (0, 3, 7, 20, 10_000)]
    for r in out.select("text", token_counts.total_tokens().alias("n"), token_counts.longest_prefix(budget).alias("p"), F.size("prefix_chars").alias("s"), *ask).collect():
        t = r.text
        counts = [library(t[:i]) for i in range(len(t) + 1)]
        assert r.n == counts[-1] and r.s <= len(t) + 1
        assert r.p == max(i for i, n in enumerate(counts) if n <= budget), repr(t)
        for c in (0, 3, 7, 20, 10_000):
            assert r[f"w{c}"] == counts[min(c, len(t))], (repr(t), c)


def test_changes_hold_for_every_prefix(library):  # noqa: F811
    count = token_counts.counter(PATH, P.PATTERN)
    for t in texts():
        chars, tokens = count.changes(t)
        got = [int(tokens[chars.searchsorted(i, side="right") - 1]) for i in range(len(t) + 1)]
        assert got == [library(t[:i]) for i in range(len(t) + 1)], repr(t)
