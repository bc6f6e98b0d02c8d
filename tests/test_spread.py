"""Numbering and ranking that no single task does for the whole table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hoptrail.operators import model, windows


def test_row_ids_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5_000), f"s{rng.randint(0, 3)}", i) for i in range(8_000)] + [(None, "s", -1)]
    df = spark.createDataFrame(rows, "a long, b string, i long")
    rows = [r for r in rows if r[0] is not None]  # a null segment joins nothing
    out = windows.row_ids(df.filter("a IS NOT NULL"), ["a", "b"], ["i"])
    want, at, last = {}, 0, None
    for a, b, i in sorted(rows):
        at += 1 + ((a, b) != last) if last else 1
        last = (a, b)
        want[i] = at
    assert {r.i: r.row_id for r in out.collect()} == want
    # The one window without partitions sums ranges, not segments.
    lines = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "windowspecdefinition" in x]
    assert all("windowspecdefinition(_range" in x or "windowspecdefinition(a#" in x for x in lines) and lines


@pytest.mark.parametrize("share", [0.0, 0.2, 0.9, 1.0, 1.2])
def test_kth_magnitude(spark, share):
    rng = random.Random(4)
    values = [0.0] * 20_000 + [rng.gauss(0, 1) for _ in range(30_000)] + [1e300, -1e12, float("inf"), None, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "w double")
    sizes = sorted((abs(v) for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    k = math.floor(len(sizes) * share)
    few, _, _ = model.near_kth(df, "w", share)
    assert few.count() <= model.FEW
    got = [tuple(r) for r in model.kth_magnitude(df, "w", share).collect()]
    assert len(got) == (0 < k <= len(sizes)) and all(r[1] == k and (r[0] == sizes[k - 1] or math.isnan(r[0]) and math.isnan(sizes[k - 1])) for r in got)
    assert model.kth_magnitude(df.limit(0), "w", share).select(F.col("k")).count() == 0
