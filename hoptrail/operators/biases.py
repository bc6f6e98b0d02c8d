"""How many pairs of two tables lie each distance apart, by blocks of distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The widths that a block of distances may have.
NARROW, WIDE = 1 << 12, 1 << 20
#: Fixed value: points beyond which a product of pairs is left to the transform.
FEW_PAIRS = 1 << 22


def _counts(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, first: int, width: int) -> np.ndarray:
    """Weighted pairs (a, b) by a - b - first, for distances of ``width`` from ``first``; exact while totals stay below 2**53."""
    out = np.zeros(width, np.int64)
    if len(a) * len(b) <= FEW_PAIRS:
        far = (a[:, None] - b[None, :] - first).ravel()
        here = (far >= 0) & (far < width)
        np.add.at(out, far[here], (n[:, None] * m[None, :]).ravel()[here])
        return out
    # A block of b spans less than width, so its partners span less than twice that.
    low_a, low_b = int(a.min()), int(b.min())
    size = 1 << (int(a.max()) - low_a + int(b.max()) - low_b + 1).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    np.add.at(x, a - low_a, n)
    np.add.at(y, int(b.max()) - b, m)
    both = np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)).astype(np.int64)
    at = low_a - int(b.max()) - first  # the distance of the transform's place 0
    lo, hi = max(0, -at), min(size, width - at)
    if hi > lo:
        out[lo + at : hi + at] = both[lo:hi]
    return out


def most_covered(left: DataFrame, right: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """bias, coverage: the distance a - b that most pairs of equal ``by`` have; the smallest magnitude, then the smallest, on ties.

    Distances are cut into blocks about as wide as the span of ``b``: a task counts one block, from the points
    that can reach it, by a transform for each block of ``b`` and value of ``by``. So points travel
    to few blocks and pairs are never listed.
    """
    once = lambda df, c, side: df.dropna(subset=[by, c]).groupBy(F.col(by).alias("by"), F.col(c).cast("bigint").alias("at")).agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    xs, ys = once(left, a, 0), once(right, b, 1)
    span = ys.agg(F.min("at"), F.max("at")).first()
    if span[0] is None:
        return left.sparkSession.createDataFrame([], "bias long, coverage long")
    low = span[0]
    width = min(WIDE, max(NARROW, 1 << int(span[1] - low).bit_length()))
    cells = ys.select(F.floor((F.col("at") - low) / width).alias("cell")).distinct()
    blocks = xs.select(F.floor((F.col("at") - low) / width).alias("own")).distinct()
    # A point of block p and one of cell c are between (p - c - 1) and (p - c + 1) widths apart.
    shift = F.explode(F.array(F.lit(-1), F.lit(0)))
    reach = blocks.crossJoin(cells).select("own", "cell", shift.alias("_s")).select("own", "cell", (F.col("own") - F.col("cell") + F.col("_s")).alias("block"))
    to = lambda df, c: df.withColumn(c, F.floor((F.col("at") - low) / width)).join(reach.select(c, "block").distinct(), c).select("block", "side", "by", "at", "n")

    def best(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        first = block * width
        side, key, at, n = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("side", "by", "at", "n"))
        at = at - np.where(side == 1, low, 0)  # b from 0 on
        keys, key = np.unique(key, return_inverse=True)
        order = np.lexsort((side, key))
        side, key, at, n = side[order], key[order], at[order], n[order]
        cuts, total = np.searchsorted(key, np.arange(len(keys) + 1)), np.zeros(width, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            p, pn, q, qn = at[lo:mid] - low, n[lo:mid], at[mid:hi], n[mid:hi]
            for cell in np.unique(q // width):
                here = q // width == cell
                near = (p >= first + cell * width) & (p < first + (cell + 2) * width)
                if here.any() and near.any():
                    total += _counts(p[near], pn[near], q[here], qn[here], first, width)
        most = int(total.max())
        if not most:
            return pa.table({"bias": pa.array([], pa.int64()), "coverage": pa.array([], pa.int64())})
        found = np.flatnonzero(total == most) + first
        bias = min(found.tolist(), key=lambda d: (abs(d), d))
        return pa.table({"bias": pa.array([bias], pa.int64()), "coverage": pa.array([most], pa.int64())})

    both = to(xs, "own").unionByName(to(ys, "cell"))
    return both.groupBy("block").applyInArrow(best, "bias long, coverage long").orderBy(F.desc("coverage"), F.abs("bias"), "bias").limit(1)
