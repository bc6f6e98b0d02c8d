"""Benchmark decontamination by suffix arrays over the training texts.

Each task cuts its documents into shards of some megabytes and builds the suffix
array of each shard's words: every suffix of every document, in order of all its
words. Every suffix of every benchmark item is then searched in it by bisection,
word by word: a suffix keeps the range of the array whose suffixes begin with its
words so far, and a range that stands after a whole window gives all places
where that window occurs. Runs of windows on one diagonal are the longest
verbatim matches and where they lie. No document is shuffled.

Tasks hold the hashed words of at most ``block_chars`` characters of benchmark
items; a larger benchmark takes further passes, which are added up per document.

Defined cases: null and empty texts have no words and no matches; benchmark
items without words match nothing; items that share an item_id are one item;
windows of items with a null item_id count as hits but name no item; an item of
over ``block_chars`` characters is an error. Rows of documents pass through one by
one, repeated ones too, whatever their names; result columns replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.llm.scratch import bounded_batches, looked_up, materialize
from hoptrail.llm.words import ALNUM, hashed_words, slices, string_buffers

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("item_word", T.IntegerType())]))
_ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())]))


class SuffixArray:
    """All suffixes of the documents of a shard in order; a document's end comes before any word."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.words = ids.reshape(-1).astype(np.int64) + 1
        self.ends = np.repeat(first[1:], np.diff(first))
        self.order = self._sorted()
        self.starts = np.searchsorted(self.words[self.order], np.arange(len(self.vocabulary) + 2))

    def word(self, suffix: np.ndarray, depth: int) -> np.ndarray:
        """The word so far into suffixes; 0 beyond their end."""
        at = suffix + depth
        return np.where(at < self.ends[suffix], self.words[np.minimum(at, len(self.words) - 1)], 0)

    def _sorted(self) -> np.ndarray:
        """By as many words as a number holds, then by twice as many as before among those that still tie."""
        every = np.arange(len(self.words))
        bits = max(1, len(self.vocabulary).bit_length())  # a shard may have no word at all
        depth = max(1, 62 // bits)
        key = self.words.copy()
        for j in range(1, depth):
            key = key << bits | self.word(every, j)
        order = np.argsort(key, kind="stable")
        rank, slots, groups = np.empty(len(order), np.int64), every, 0
        key = key[order]
        while len(slots):
            new = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1
            rank[order[slots]] = slots[new][group]
            tied = (np.bincount(group) > 1)[group]
            if new.sum() == groups:  # nothing came apart, and so nothing will
                break
            slots = slots[tied]
            groups = int((tied & new).sum())
            suffix = order[slots]
            at = suffix + depth
            after = np.where(at < self.ends[suffix], rank[np.minimum(at, len(rank) - 1)] + 1, 0)
            key = rank[suffix] << 32 | after
            again = np.argsort(key, kind="stable")
            order[slots], key = suffix[again], key[again]
            depth *= 2
        return order

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """The first place in each range whose suffix has at least ``word`` at ``depth``, by bisection."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.word(self.order[mid], depth) < word[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def search(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """All places where a window of the benchmark occurs: word positions and benchmark positions."""
        none = np.zeros(0, np.int64)
        if not len(self.words) or not len(bench.starts):
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, bench.hashes), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == bench.hashes, at + 1, 0)
        some = np.flatnonzero(ids[bench.starts])
        start, length = bench.starts[some], bench.lengths[some]
        lo, hi = self.starts[ids[start]], self.starts[ids[start] + 1]
        found: list[tuple[np.ndarray, ...]] = []
        depth = 1
        while len(start):
            whole = length == depth
            found.append((start[whole], lo[whole], hi[whole]))
            start, length, lo, hi = (x[~whole] for x in (start, length, lo, hi))
            word = ids[start + depth]
            lo = self._bound(lo, hi, depth, word)
            hi = self._bound(lo, hi, depth, word + 1)
            stay = (word > 0) & (lo < hi)
            start, length, lo, hi = (x[stay] for x in (start, length, lo, hi))
            depth += 1
        start, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        count = hi - lo
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return self.order[place], np.repeat(start, count)


class Benchmark:
    """The hashed words of benchmark items, and where their windows start: all suffixes of at least a window, or a shorter item as one."""

    def __init__(self, item_ids: list[int | None], texts: list[str | None], window: int):
        raw, offsets = string_buffers(pa.array(texts, pa.string()))
        self.hashes, first = hashed_words(raw, offsets, ALNUM)
        sizes = np.diff(first)
        self.item_ids = item_ids
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.pos = np.arange(len(self.hashes)) - np.repeat(first[:-1], sizes)
        left = sizes[self.item] - self.pos
        self.starts = np.flatnonzero((left >= window) | (self.pos == 0))
        self.lengths = np.minimum(left[self.starts], window)
        #: Words of the window that starts at a position.
        self.size = np.minimum(left, window)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint [start, end) pairs that cover the same words."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.column_stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]])


def _longest(bench: Benchmark, p: np.ndarray, own: np.ndarray) -> list[tuple]:
    """The longest match of each item in one document: (item, words, document word, item word)."""
    q, size, item = bench.pos[own], bench.size[own], bench.item[own]
    order = np.lexsort((p, p - q, item))
    p, q, size, item = p[order], q[order], size[order], item[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)]
    run = np.flatnonzero(new)
    last = np.r_[run[1:] - 1, len(p) - 1]
    words = p[last] + size[last] - p[run]
    best: dict = {}
    for i, w, a, b in zip(item[run].tolist(), words.tolist(), p[run].tolist(), q[run].tolist(), strict=True):
        key = bench.item_ids[i]
        if key not in best or (-w, a, b) < best[key]:
            best[key] = (-w, a, b)
    return [(k, -w, a, b) for k, (w, a, b) in best.items()]


def _overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_chars: int = 32_000_000, shard_bytes: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` as a struct, with n_words, spans of words in windows, and matches."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of the input can clash
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("matches", MATCH)])
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).filter(F.col("t").isNotNull())
    size, most = items.agg(F.coalesce(F.sum(F.char_length("t").cast("long")), F.lit(0)), F.coalesce(F.max(F.char_length("t")), F.lit(0))).first()
    if most > block_chars:
        raise ValueError(f"a benchmark item has over {block_chars} characters")
    if size <= block_chars:
        return _one_pass(rows, items, place, schema, window, shard_bytes)[0]
    # Items in order of their hashes, dealt by the sum of characters so far into passes of at most block_chars and one item.
    sized = materialize(items.select("i", "t", F.xxhash64("i", "t").alias("h")), "benchmark")
    parts = -(-4 * size // block_chars)
    kinds = sized.groupBy(F.pmod("h", F.lit(parts)).alias("part")).agg(F.sum(F.char_length("t").cast("long")).alias("n")).orderBy("part").collect()  # of a number of parts that the bound gives
    passes: list[list[int]] = [[]]
    held = 0
    for kind in kinds:
        if held and held + kind.n > block_chars:
            passes.append([])
            held = 0
        passes[-1].append(kind.part)
        held += kind.n
    numbered = materialize(rows.withColumn("digest", F.sha2(F.coalesce(F.col("row")[text_col], F.lit("")), 256)), "documents")
    texts = numbered.select(F.struct(F.col("row")[text_col].alias("text"), F.col("digest")).alias("row"))
    text_schema = T.StructType([texts.schema["row"], *schema.fields[1:]])
    found = None
    for part in passes:
        own, held_items = _one_pass(texts, sized.filter(F.pmod("h", F.lit(parts)).isin(part)), 0, text_schema, window, shard_bytes)
        hits = materialize(own.filter(F.size("spans") > 0).select("row.digest", "spans", "matches").dropDuplicates(["digest"]), "hits")
        held_items.destroy()
        found = hits if found is None else found.unionByName(hits)
    spans = F.flatten(F.collect_list("spans"))  # at most one list a pass
    merged = found.groupBy("digest").agg(spans.alias("spans"), F.flatten(F.collect_list("matches")).alias("matches"))
    longest = F.filter("matches", lambda m: ~F.exists("matches", lambda o: o["item_id"].eqNullSafe(m["item_id"]) & (o["words"] > m["words"])))
    counted = _one_pass(numbered.select("row"), items.limit(0), place, schema, window, shard_bytes)[0].select("row", "n_words", F.sha2(F.coalesce(F.col("row")[text_col], F.lit("")), 256).alias("digest"))
    out = looked_up(counted, materialize(merged.select("digest", "spans", longest.alias("matches")), "merged"), ["digest"], "left")
    return out.select("row", "n_words", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("matches", F.array().cast(MATCH)).alias("matches"))


def _one_pass(rows: DataFrame, items: DataFrame, place: int, schema: T.StructType, window: int, shard_bytes: int) -> tuple[DataFrame, Broadcast]:
    """The overlaps with the items, and what the tasks hold of them."""
    held = items.select("i", "t").orderBy("i", "t").collect()  # block_chars bounds it
    bench = rows.sparkSession.sparkContext.broadcast(Benchmark([r.i for r in held], [r.t for r in held], window))

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some.append(batch)
            if sum(b.nbytes for b in some) >= shard_bytes:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some = []
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bench.value
        for batch in gathered(batches):
            raw, offsets = string_buffers(batch.column(0).field(place))
            for a, b in slices(offsets, shard_bytes):
                hashes, first = hashed_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                at, found = SuffixArray(hashes, first).search(own) if len(own.starts) else (np.zeros(0, np.int64),) * 2
                doc = np.searchsorted(first, at, side="right") - 1
                order = np.argsort(doc, kind="stable")
                at, found, doc = at[order], found[order], doc[order]
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                spans, matches = [], []
                for k in range(b - a):
                    lo, hi = edges[k], edges[k + 1]
                    if lo == hi:
                        spans.append(np.zeros(0, np.int32))
                        matches.append([])
                        continue
                    p = at[lo:hi] - first[k]
                    spans.append(_merged(np.column_stack([p, p + own.size[found[lo:hi]]])).reshape(-1).astype(np.int32))
                    matches.append([dict(zip(("item_id", "words", "doc_word", "item_word"), m, strict=True)) for m in _longest(own, p, found[lo:hi])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.int32())), pa.array(matches, _ARROW_MATCH)], names=["row", "n_words", "spans", "matches"])

    return rows.mapInArrow(run, schema), bench


def _hit_words() -> F.Column:
    """Words that lie in some span; spans of several passes may overlap."""
    pairs = F.sort_array(F.transform(F.filter("spans", lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("start"), F.get("spans", 2 * i + 1).alias("end"))))
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(x["end"], s["to"]).alias("to")),
        lambda s: s["n"],
    )


def find_overlaps(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` with n_words, n_hit and ``matches``: each matching item, its longest match and where it lies."""
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "matches")]
    counted = _overlaps(docs, benchmark, **how).select("row", "n_words", _hit_words().alias("n_hit"), "matches")
    return counted.select(*[F.col("row")[c].alias(c) for c in own], "n_words", "n_hit", "matches")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns."""
    return _overlaps(docs, benchmark, **how).filter(F.size("spans") == 0).select("row.*")
