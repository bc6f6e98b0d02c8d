"""Near-duplicate documents by one-permutation MinHash.

1. Each document becomes its set of word shingles. Equal sets form one class,
   found by an aggregation over set digests, so groups of copies never meet in
   one task; only class representatives go on.
2. Sketch: ``passes`` independent one-permutation hashings of ``bins`` bins each
   with optimal densification (an empty bin takes the value of a bin chosen by
   a fixed random sequence), cut into bands of ``rows`` bins.
3. Members of a band's bucket are joined to the bucket's centre alone, a star,
   so candidates grow with the bucket, not with its square. Links that hold on
   the full sets give components.
4. A star can miss a link between two members when neither is linked to the
   centre. Members of buckets that hold several components are compared again,
   after another star across components, by a prefix filter that loses no link: shingles are ordered from rare to common, and the first shingle that
   two linked sets share stands early enough in both to leave room for what they
   must share. Rows are keyed by shingle and by the two size classes for which
   this holds, so members of a common template that are merely alike don't meet.
   Keys of one component are left out, large ones are salted, ids alone are
   joined, and sketches and sets are fetched for candidates. Nothing is dropped
   or cut.

Confirmation intersects full sets. Intermediate tables are written to the
shared folder, so lost executors cost a task and not the run.

Defined cases: texts that are null or without words have an empty set and are
linked with nothing; texts of fewer words than a shingle have one shingle, the
whole sequence; rows that share a doc_id are one node; a null doc_id gets a null
component and is kept. ``near_duplicates`` returns its four columns alone,
``deduplicate`` all columns of the kept documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoptrail.llm.components import connected_components
from hoptrail.llm.scratch import bounded_batches, broadcast_within, looked_up, materialize, release, shuffled
from hoptrail.llm.words import SPACED, U, hashed_words, mix, slices, string_buffers

_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_ODD = (np.arange(1, 65, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
#: Documents of at most so many candidates are found by a broadcast of their ids; more by a shuffled join.
BROADCAST_ROWS = 1_000_000
#: Copies from which on a set's rows look their component up, instead of meeting in one task.
HOT_ROWS = 1_000
#: Hash slots in which shingles are counted to order them, and the rows of a key that one salt takes.
SLOTS, SALT_ROWS = 1 << 19, 1_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of ``n`` words, per row."""
    hashes, first = hashed_words(raw, offsets, SPACED)
    with np.errstate(over="ignore"):
        if len(hashes) >= n:
            rolled = reduce(np.add, (hashes[j : len(hashes) - n + 1 + j] * _ODD[j] for j in range(n)))
            rolled = mix(rolled)
        else:
            rolled = np.zeros(0, U)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                short = reduce(np.add, (hashes[a + j] * _ODD[j] for j in range(b - a))) + U(b - a)
                out.append(mix(np.array([short], U)))
            else:
                out.append(np.zeros(0, U))
    return out


def _steps(bins: int, n: int = 64) -> np.ndarray:
    """For each try, the bin that each bin borrows from; the same for all sets."""
    at = np.arange(bins, dtype=U)
    return np.stack([(mix(at + U(1000 * t + 7)) % U(bins)).astype(np.int64) for t in range(n)])


def sketches(sets: list[np.ndarray], passes: int, bins: int) -> np.ndarray:
    """The sketch of each set that isn't empty: ``passes * bins`` values."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, U)
    row = np.repeat(np.arange(len(sets)), sizes)
    steps = _steps(bins)
    out = np.empty((len(sets), passes, bins), U)
    for p in range(passes):
        with np.errstate(over="ignore"):
            h = mix(values ^ U(0x5851F42D4C957F2D * (p + 1) & 0xFFFFFFFFFFFFFFFF))
        own = row * bins + ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)
        flat = np.full(len(sets) * bins, _EMPTY)
        np.minimum.at(flat, own, h)
        filled = flat.reshape(len(sets), bins)
        empty = np.argwhere(filled == _EMPTY)
        result = filled.copy()
        t = 0
        while len(empty):  # each set has a filled bin, and every round tries another one
            if t < len(steps):
                source = steps[t][empty[:, 1]]
            else:
                source = (empty[:, 1] + t) % bins
            got = filled[empty[:, 0], source]
            good = got != _EMPTY
            result[empty[good, 0], empty[good, 1]] = got[good]
            empty = empty[~good]
            t += 1
        out[:, p] = result
    return out.reshape(len(sets), passes * bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` values; the band's number is part of it."""
    n = sketch.shape[1] // rows
    cut = sketch[:, : n * rows].reshape(len(sketch), n, rows)
    with np.errstate(over="ignore"):
        key = reduce(np.add, (cut[:, :, j] * _ODD[j] for j in range(rows))) + np.arange(n, dtype=U)[None, :] * U(0xD1342543DE82EF95)
        return mix(key)


def sketch_table(docs: DataFrame, id_col: str, text_col: str, shingle: int, passes: int, bins: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set digest (two longs), sketch (low 16 bits of each value) and band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets, 4_000_000):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                size = np.array([len(s) for s in sets])
                digests = np.array([np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
                full = np.flatnonzero(size)
                sketch = sketches([sets[i] for i in full], passes, bins)
                keys = band_keys(sketch, rows).view(np.int64)
                low = (sketch & U(0xFFFF)).astype(np.uint16).view(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        _spread(low, size > 0, pa.int16()),
                        _spread(keys, size > 0, pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sketch", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<short>, bands array<long>")


def _spread(values: np.ndarray, full: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: a row of ``values`` where ``full``, else an empty list."""
    ends = np.concatenate([[0], np.cumsum(full * (values.shape[1] if values.ndim == 2 else 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def set_table(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id and its full shingle set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets, 4_000_000):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc_id", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, shingles array<long>")


def size_class(n: np.ndarray) -> np.ndarray:
    """A number that grows with the size: exact below 32, then 16 classes for each doubling."""
    e = np.maximum(np.frexp(n.astype(np.float64))[1] - 5, 0)
    return 16 * e + (n >> e)


def prefix_rows(members: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """A row for each shingle and partner size class by which a set (rep, label, shingles) could find a linked one.

    Sets of sizes n and m are linked when they share at least percent * (n + m) / (100 + percent)
    shingles. If the first they share stands at place i of n, at most n - i are shared.
    """
    per = percent

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            ends = batch.column(2).offsets.to_numpy()
            values = batch.column(2).values.to_numpy()
            for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                n = b - a
                least = -(-per * n // 100)
                seen = counts[values[a:b] & (SLOTS - 1)]
                order = np.lexsort((values[a:b], seen))[: n - least + 1]
                i = np.arange(len(order))
                most = np.minimum(100 * n // per, (100 + per) * (n - i) // per - n)
                good = (most >= least) & (seen[order] > 1)  # a shingle that is alone in its slot has one set
                order, i, most = order[good], i[good], most[good]
                low, high = size_class(np.array([least]))[0], size_class(most)
                times = high - low + 1
                other = low + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                out.append([np.repeat(values[a:b][order], times), other, np.repeat(i, times), np.full(len(other), k), np.full(len(other), n)])
            token, other, place, row, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
            own = size_class(n)
            for at in range(0, len(token), 500_000):
                cut = slice(at, at + 500_000)
                pick = pa.array(row[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[cut]), *(pa.array(x[cut].astype(np.int32)) for x in (np.minimum(own, other), np.maximum(own, other), own, n - place, n)), batch.column(0).take(pick), batch.column(1).take(pick)],
                    names=["token", "small", "large", "own", "room", "n", "rep", "label"],
                )

    return members.select("rep", "label", "shingles").mapInArrow(run, "token long, small int, large int, own int, room int, n int, rep long, label long")


def _agreeing(a: str, b: str) -> F.Column:
    """Sketch values that two rows share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


class NearDedup:
    """One run over one table; see the module's description."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, passes: int, bins: int, rows: int, slack: float):
        self.docs, self.id_col, self.text_col, self.shingle, self.percent = docs, id_col, text_col, shingle, percent
        bounded_batches(docs.sparkSession)
        self.values = passes * bins
        #: Sketch values that must agree: the threshold less five standard deviations.
        share = percent / 100
        self.least_agree = int(self.values * share - slack * (self.values * share * (1 - share)) ** 0.5)
        self.sketched = materialize(sketch_table(docs, id_col, text_col, shingle, passes, bins, rows), "sketches")
        # One row for each distinct set: its smallest doc_id, size, sketch and bands.
        full = self.sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        self.held = materialize(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")

    def sizes_fit(self, a: str, b: str) -> F.Column:
        return (F.col(a) * 100 >= F.col(b) * self.percent) & (F.col(b) * 100 >= F.col(a) * self.percent)

    def star(self, buckets: DataFrame, turn: int) -> DataFrame:
        """Pairs of the bucket's centre and each other member of another component, of fitting sizes.

        The first two turns rank members alike in all buckets, so that a group meets few centres.
        """
        rank = F.xxhash64(F.lit(turn), *(["key"] if turn > 1 else []), "rep")
        centre = F.min_by(F.struct("rep", "n", "label"), F.struct(rank.alias("r"), F.col("rep"))).alias("c")
        centres = buckets.groupBy("key").agg(centre, F.count("*").alias("m")).filter("m > 1").select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.label").alias("centre_label"))
        pairs = buckets.join(shuffled(centres), "key").filter("label != centre_label").filter(self.sizes_fit("n", "centre_n"))
        return pairs.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()

    def near(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs whose sketches agree often enough to be links."""
        one, two = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
        return shuffled(shuffled(pairs).join(one, "a")).join(two, "b").filter(_agreeing("sa", "sb") >= self.least_agree).select("a", "b")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """Full shingle sets of the documents of a written table of ids."""
        some = self.docs.withColumn("_id", F.col(self.id_col).cast("long")).join(broadcast_within(ids, BROADCAST_ROWS), F.col("_id") == ids.doc_id, "left_semi")
        return set_table(some, "_id", self.text_col, self.shingle).filter(F.size("shingles") > 0)

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
        sets = materialize(self.sets_of(ids), f"{name}-sets")
        one, two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        kept = shuffled(shuffled(pairs).join(one, "a")).join(two, "b").withColumn("both", both).filter(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * self.percent)
        return materialize(kept.select("a", "b").distinct(), f"{name}-links")

    def mixed(self, buckets: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The rows of buckets that hold several components of the links so far, with the components as labels."""
        labels = materialize(connected_components(links), f"{name}-labels")
        marked = buckets.drop("label").join(shuffled(labels.withColumnRenamed("node", "rep")), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
        several = materialize(marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key"), f"{name}-several")
        return materialize(looked_up(marked, several, ["key"], "inner"), f"{name}-mixed")

    def links(self) -> DataFrame:
        """Confirmed links between class representatives that connect every component."""
        sketches = self.held.select("rep", "sketch")
        members = self.held.select("rep", "n", F.explode("bands").alias("key"))
        shared = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
        buckets = materialize(members.join(shuffled(shared), "key").withColumn("label", F.col("rep")), "buckets")
        tested = materialize(self.near(self.star(buckets, 0).unionByName(self.star(buckets, 1)).distinct(), sketches), "star")
        links = self.confirm(tested, "star")
        left = self.mixed(buckets, links, "star")
        again = materialize(self.near(self.star(left, 2).join(shuffled(tested), ["a", "b"], "left_anti"), sketches), "second")
        tested = tested.unionByName(again)
        links = links.unionByName(self.confirm(again, "second"))
        # Buckets that still hold several components: pairs across components, each once.
        ids = materialize(self.mixed(left, links, "second").select("rep", "label").distinct(), "mixed-ids")
        sets = self.sets_of(ids.select(F.col("rep").alias("doc_id"))).groupBy(F.col("doc_id").alias("rep")).agg(F.first("shingles").alias("shingles"))
        rest = self.across(materialize(sets.join(shuffled(ids), "rep"), "mixed-sets"))
        release(self.docs.sparkSession)
        return links.unionByName(self.confirm(materialize(self.near(rest.join(shuffled(tested), ["a", "b"], "left_anti"), sketches), "rest"), "rest"))

    def keyed(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the prefix filter, and its keys that hold several components: largest component, salts and pairs to visit."""
        slots = members.select(F.explode(F.transform("shingles", lambda x: x.bitwiseAND(F.lit(SLOTS - 1)).cast("int"))).alias("slot")).groupBy("slot").agg(F.least(F.count("*"), F.lit(65_535)).cast("int").alias("c")).toArrow()
        counts = np.zeros(SLOTS, np.uint16)
        counts[slots.column("slot").to_numpy()] = slots.column("c").to_numpy()
        rows = materialize(prefix_rows(members, counts, self.percent), "prefixes")
        key = ["token", "small", "large"]
        per = rows.groupBy(*key, "label").agg(F.count_if(F.col("own") == F.col("small")).alias("l"), F.count_if(F.col("own") == F.col("large")).alias("r"))
        main = F.max_by(F.struct("label", "l", "r"), F.struct(F.col("l") + F.col("r"), "label")).alias("m")
        groups = per.groupBy(*key).agg(main, F.count("*").alias("labels"), F.sum("l").alias("ls"), F.sum("r").alias("rs")).filter("labels > 1 AND ls > 0 AND rs > 0")
        visits = F.col("ls") * F.col("rs") - F.col("m.l") * F.col("m.r")
        return rows, materialize(groups.select(*key, F.col("m.label").alias("main"), F.ceil(F.col("rs") / SALT_ROWS).cast("int").alias("salts"), visits.alias("visits")), "prefix-keys")

    def across(self, members: DataFrame) -> DataFrame:
        """Pairs of members (rep, label, shingles) of two components that may be links; no link is missed."""
        rows, groups = self.keyed(members)
        key = ["token", "small", "large"]
        held = materialize(rows.join(shuffled(groups.drop("visits")), key), "prefix-rows")
        left = held.filter("own = small").select(*key, "main", *[F.col(c).alias(f"{c}_a") for c in ("rep", "n", "room", "label")], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        right = held.filter("own = large").select(*key, *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "room", "label")], F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"), (F.col("label") == F.col("main")).alias("main_b"))

        def pairs(one: DataFrame, two: DataFrame) -> DataFrame:
            fits = self.sizes_fit("n_a", "n_b") & (F.least("room_a", "room_b").cast("long") * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")).cast("long") * self.percent)
            once = (F.col("l.small") < F.col("l.large")) | (F.col("rep_a") < F.col("rep_b"))
            same = reduce(lambda x, c: x & (F.col(f"l.{c}") == F.col(f"r.{c}")), [*key[1:], "salt"], F.col("l.token") == F.col("r.token"))
            return one.alias("l").join(shuffled(two.alias("r")), same & (F.col("label_a") != F.col("label_b")) & once & fits).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))

        return pairs(left.filter("label_a != main"), right).unionByName(pairs(left.filter("label_a = main"), right.filter("NOT main_b"))).distinct()

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept, one row for each row of the table."""
        labels = connected_components(self.links())
        classes = materialize(self.held.select("d1", "d2", "rep", "copies").join(shuffled(labels.withColumnRenamed("node", "rep")), "rep", "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component")), "labelled")
        # Sets of many rows are few: those rows look theirs up, whatever share of the table one set has.
        hot = materialize(classes.filter(F.col("copies") > HOT_ROWS).select("d1", "d2", F.col("component").alias("hot")), "hot-classes")
        rows = self.sketched.select("doc_id", "n_shingles", "d1", "d2")
        marked = looked_up(rows.filter("n_shingles > 0"), hot, ["d1", "d2"], "left")
        cold = marked.filter("hot IS NULL").join(shuffled(classes.filter(F.col("copies") <= HOT_ROWS).drop("copies")), ["d1", "d2"], "left")
        out = cold.select("doc_id", "n_shingles", "component").unionByName(marked.filter("hot IS NOT NULL").select("doc_id", "n_shingles", F.col("hot").alias("component")))
        out = out.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, passes: int = 4, bins: int = 48, rows: int = 6, slack: float = 5.0) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept for every row of ``docs``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets.
    """
    return NearDedup(docs, id_col, text_col, shingle, percent, passes, bins, rows, slack).result()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id."""
    gone = materialize(near_duplicates(docs, id_col, text_col, **how).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    return docs.join(broadcast_within(gone, BROADCAST_ROWS), docs[id_col].cast("long") == gone["_gone"], "left_anti")
