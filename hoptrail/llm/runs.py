"""Periodic runs: stretches of words that repeat themselves, and texts without the repeats.

A run has a smallest period q (words q apart are identical), at least ``least``
words and at least ``times`` periods, and no neighbouring word continues it.
Every run has an occurrence of a Lyndon word of length q that is the longest
Lyndon word at its place under an order of the words or under the reverse order.
So the words are scanned from right to left under both orders with a stack of
Lyndon words: while the suffix at a place is less than the suffix after its word,
the two words become one. Suffixes are compared, and the periods found are
extended to both sides, by longest common extensions: prefix hashes modulo a
prime and bisection say how far two places agree, and the words themselves are
then compared, so that no collision of hashes reaches a result. Stretches of a
distance that were compared before aren't compared again.

One document is scanned in one task, in memory linear in its words; rows are
spread as they were read and nothing is shuffled.

Defined cases: null, empty and blank texts have no words, no runs and an empty
collapsed text; ``least`` and ``times`` (2 at least) bound what counts; repeated
rows get repeated results; extra columns pass through whatever their names, and
result columns replace columns of the same name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.llm.scratch import bounded_batches

#: The prime and the base of the prefix hashes.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_001_000_037
#: Words compared one by one before hashes are.
_NEAR = 12
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
_powers = array("Q", [1])


def _powers_to(n: int) -> array:
    while len(_powers) <= n:
        _powers.append(_powers[-1] * _BASE % _PRIME)
    return _powers


class Extensions:
    """How far two places of a list of word numbers agree, to the right and to the left."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self._raw = self._hash = self._power = None
        self._compared: dict[int, tuple[int, int]] = {}

    def _hashes(self) -> None:
        """Made for the first places that agree beyond a few words."""
        self._raw = array("i", self.ids).tobytes()
        self._hash = array("Q", accumulate(self.ids, lambda h, x: (h * _BASE + x + 1) % _PRIME, initial=0))
        self._power = _powers_to(self.n)

    def _alike(self, i: int, j: int, k: int) -> bool:
        h = self._hash
        return (h[i + k] - h[j + k] - (h[i] - h[j]) * self._power[k]) % _PRIME == 0

    def _differs(self, i: int, j: int, stop: int) -> int:
        """The first x in [i, stop) whose word is not that of x + j - i, or ``stop``."""
        step, raw = j - i, self._raw
        lo, hi = self._compared.get(step, (i, i))
        if lo <= i <= hi:
            parts = [(max(i, hi), stop)]
            known = (lo, max(hi, stop))
        elif i < lo <= stop:
            parts = [(i, lo), (hi, stop)]
            known = (i, max(hi, stop))
        else:
            parts, known = [(i, stop)], (i, stop)
        for a, b in parts:
            if a < b and raw[4 * a : 4 * b] != raw[4 * (a + step) : 4 * (b + step)]:
                return next(x for x in range(a, b) if self.ids[x] != self.ids[x + step])
        self._compared[step] = known
        return stop

    def right(self, i: int, j: int) -> int:
        """Words that agree from i < j on."""
        ids, most = self.ids, self.n - j
        for k in range(min(_NEAR, most)):
            if ids[i + k] != ids[j + k]:
                return k
        if most <= _NEAR:
            return most
        if self._hash is None:
            self._hashes()
        lo, size = _NEAR, 2 * _NEAR
        while size < most and self._alike(i, j, size):
            lo, size = size, 2 * size
        hi = min(size, most)
        if hi == most and self._alike(i, j, most):
            lo = most
        else:
            while lo + 1 < hi:  # alike at lo, not at hi
                mid = (lo + hi) >> 1
                if self._alike(i, j, mid):
                    lo = mid
                else:
                    hi = mid
        return self._differs(i, j, i + lo) - i

    def left(self, i: int, j: int) -> int:
        """Words that agree before i < j."""
        ids = self.ids
        for k in range(min(_NEAR, i)):
            if ids[i - 1 - k] != ids[j - 1 - k]:
                return k
        if i <= _NEAR:
            return i
        if self._hash is None:
            self._hashes()
        lo, size = _NEAR, 2 * _NEAR
        while size < i and self._alike(i - size, j - size, size):
            lo, size = size, 2 * size
        hi = min(size, i)
        if hi == i and self._alike(0, j - i, i):
            lo = i
        else:
            while lo + 1 < hi:
                mid = (lo + hi) >> 1
                if self._alike(i - mid, j - mid, mid):
                    lo = mid
                else:
                    hi = mid
        if self._differs(i - lo, j - lo, i) < i:  # hashes collided: the last difference counts
            return next(k for k in range(lo) if ids[i - 1 - k] != ids[j - 1 - k])
        return lo


def runs_of(ids: list[int], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of word numbers, in order."""
    n = len(ids)
    if n < max(least, times):
        return []
    reach = Extensions(ids)
    right = reach.right
    found: set[tuple[int, int, int]] = set()
    for order in ([*ids, -1], [*(-x for x in ids), -max(ids) - 1]):  # an end less than any word
        after = array("q", bytes(8 * (n + 1)))  # where the longest Lyndon word at each place ends: the stack, linked
        for i in range(n - 1, -1, -1):
            a, j, same = order[i], i + 1, 0
            b = order[j]
            while a <= b:
                if a == b:
                    c, d = order[i + 1], order[j + 1]
                    if c != d:
                        if c > d:
                            same = 1
                            break
                    else:
                        same = right(i, j)
                        if order[i + same] > order[j + same]:
                            break  # the later suffix is less
                        same = 0
                j = after[j]
                b = order[j]
            after[i] = j
            # The first Lyndon word of a long enough run agrees with what follows for so many words at least.
            if same:
                period = j - i
                if same > (times - 2) * period and same > least - 2 * period:
                    before = reach.left(i, j)
                    length = before + period + same
                    if length >= max(least, times * period):
                        found.add((i - before, length, period))
    return sorted(found)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[at : max(at, begin)]
        at = max(at, end)
    return b" ".join(kept + words[at:])


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without repeats."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text else []  # at ASCII blanks, since the text is bytes
                seen: dict[bytes, int] = {}
                found = runs_of([seen.setdefault(w, len(seen)) for w in words], least, times)
                sizes.append(len(words))
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(_collapsed(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(lists, _ARROW_RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "n_words", "runs", "collapsed"])

    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in own], "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length by period; on ties the smallest start, then period; null without runs."""

    def better(a: Column, b: Column) -> Column:
        mine, other = b["length"] * a["period"], a["length"] * b["period"]
        return a.isNull() | (mine > other) | ((mine == other) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])))

    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, b: F.when(better(a, b), b).otherwise(a))
