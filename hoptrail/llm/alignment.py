"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, and counts of linked ids.

A state is the side that leads and the bytes of its last token that the other
side hasn't matched yet. The side that lags gives the next token: it either is a
prefix of what dangles, which shortens, or goes beyond it, and then leads with
its own rest. When nothing dangles both sides end at the same byte and a group
closes. Transitions are memoised by state and token. Each step of the side that
lags links its token to the token that leads: the two overlap.

Texts go through the transducer in segments that begin where both tokenizers
certainly begin a token: at a blank or line feed after another character than
white space, after a line feed before one, and at some marks after letters. That
no piece of the vocabulary reaches over such a place is checked when the model is
read. A segment is encoded and aligned once in a worker's memory; longer ones
aren't kept there.

``score_links`` counts every pair of ids over the whole table. Batches of
documents make blocks, each with a dictionary of its distinct pairs; dictionaries
alone, not the documents' links, are aggregated and joined with the counts, and
go back to the documents of their block. A pair is in a dictionary once, so no
pair has a larger share of the rows than any dictionary gives it.

Defined cases: texts that are null or empty, or whose joined tokens differ from a
blank and the text, have no tokens, no groups and no links; repeated rows count
as often as they stand there; extra columns pass through whatever their names,
and result columns replace columns of the same name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.llm.scratch import bounded_batches, materialize

#: Longest segment that a worker's memory keeps, its segments, the transducer's transitions, and characters encoded at once.
KEEP_CHARS, KEEP_SEGMENTS, KEEP_STEPS, STRETCH = 48, 350_000, 1_000_000, 1_000_000
#: Rows and bytes of a block of documents.
BLOCK_ROWS, BLOCK_BYTES = 4_000, 32_000_000
#: Marks after letters at which a segment may begin, if no piece has a letter or digit before them; the apostrophe may begin a contraction.
_MARKS = ".,;:!?&%$*#|()"
_BLANK = "▁"
_RESULTS = ["n_a", "n_b", "n_groups", "groups", "pairs", "times"]
_ARROW_RESULTS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        out[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def _segments(marks: str):
    """Cuts a text where both tokenizers certainly begin a token; every segment begins at such a place."""
    mark = f"[{re.escape(marks)}]" if marks else r"(?!)"
    return re.compile(rf" ?[^\W\d_]+(?=[ \n]|{mark})|{mark}+(?=[ \n])|\n(?=\S)|\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+").findall


class Transducer:
    """Aligns two lists of ids whose bytes are given by id.

    A state is a pair: whether A gives the next token, and the memo of what each token leads to.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self._bytes = (b_bytes, a_bytes)  # of the side that lags, by whether that is A
        self._forget()

    def _forget(self) -> None:
        self._root = (True, {})
        self._states = {(True, b""): self._root}
        self._left = {id(self._root[1]): b""}
        self._kept = 0

    def _step(self, state: tuple[bool, dict], token: int) -> tuple[bool, dict] | None:
        """The state after a token of the side that lags; None where the bytes differ."""
        a_lags, memo = state
        left, read = self._left[id(memo)], self._bytes[a_lags][token]
        if read and left.startswith(read):
            side, rest = a_lags, left[len(read) :]
        elif read and read.startswith(left):
            side, rest = not a_lags, read[len(left) :]
        else:
            memo[token] = None
            return None
        if not rest:
            side = True
        found = self._states.get((side, rest))
        if found is None:
            found = self._states[side, rest] = (side, {})
            self._left[id(found[1])] = rest
        memo[token] = found
        self._kept += 1
        return found

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """The groups as text, and the links as a << 32 | b; None where the joined bytes differ."""
        if self._kept > KEEP_STEPS:
            self._forget()
        root = state = self._root
        groups: list[str] = []
        links: list[int] = []
        n_a, n_b = len(a), len(b)
        i = j = leader = from_a = from_b = 0
        while True:
            a_lags, memo = state
            if a_lags:
                if i == n_a:
                    return (groups, links) if state is root and j == n_b else None
                token = a[i]
                i += 1
                if state is not root:
                    links.append(token << 32 | leader)
            else:
                if j == n_b:
                    return None
                token = b[j]
                j += 1
                links.append(leader << 32 | token)
            try:
                state = memo[token]
            except KeyError:
                state = self._step(state, token)
            if state is root:
                if i - from_a == 1 == j - from_b:
                    groups.append(f"{a[from_a]}|{b[from_b]}")
                else:
                    groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                from_a, from_b = i, j
            elif state is None:
                return None
            elif state[0] is not a_lags:  # the token leads from here on
                leader = token


class Aligner:
    """Encodes and aligns texts; made once per Python worker."""

    def __init__(self, vocabulary_path: str, model_path: str, pattern: str):
        self.a_bytes = byte_level_tokens(vocabulary_path)
        with open(vocabulary_path, encoding="utf-8") as file:
            added = {t["id"] for t in json.load(file)["added_tokens"]}
        if not {bytes([x]) for x in range(256)} <= {*self.a_bytes}:
            raise ValueError("the first vocabulary must have every byte, so that its tokens always join to the text")
        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in added}  # its merges are in the order of its ids
        self._encode_a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._b = model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        written = [p for i, p in enumerate(pieces) if not model.is_byte(i)]
        # Pieces with a blank or a line feed after something else would make the segments wrong.
        crossing = any(re.search(rf"[^{_BLANK}]{_BLANK}|\n.|.\n", p, re.S) for p in written)
        marks = "".join(c for c in _MARKS if not any(re.search(rf"\w{re.escape(c)}", p) for p in written))
        self.segments = (lambda s: [s]) if crossing else _segments(marks)
        self._feed = len(model.encode("\n"))
        self._lone = model.piece_to_id(_BLANK)
        self._transducer = Transducer(self.a_bytes, self.b_bytes)
        self._known: dict[str, tuple] = {}

    def _encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments. The model puts a blank before what it gets; after a line feed of our own it does no harm."""
        out = self._b.encode([s[1:] if s[0] == " " else f"\n{s}" for s in segments], num_threads=1)
        return [(ids if len(s) > 1 else [self._lone]) if s[0] == " " else ids[self._feed :] for s, ids in zip(segments, out, strict=True)]

    def _learn(self, segments: list[str]) -> dict[str, tuple]:
        """For each segment its numbers of tokens and groups, its groups as text, and its links; () where the tokens don't give its bytes."""
        out = {}
        for s, b in zip(segments, self._encode_b(segments), strict=True):
            a = self._encode_a(s)
            found = self._transducer.align(a, b)
            out[s] = (len(a), len(b), len(found[0]), ";".join(found[0]), array("q", found[1]).tobytes()) if found else ()
        return out

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """For each text its numbers of tokens and groups, its groups as text, and its links."""
        known, own, missing = self._known, [], set()
        for text in texts:
            segments = self.segments(f" {text}") if text else []
            parts = list(map(known.get, segments))
            own.append((segments, parts))
            if None in parts:
                missing.update(s for s, p in zip(segments, parts, strict=True) if p is None)
        found = self._learn(list(missing))
        for segments, parts in own:
            if None in parts:
                parts = [found[s] if p is None else p for s, p in zip(segments, parts, strict=True)]
            if not parts or () in parts:
                yield 0, 0, 0, "", b""
                continue
            a, b, n, groups, links = zip(*parts, strict=True)
            yield sum(a), sum(b), sum(n), ";".join(groups), b"".join(links)
        if len(known) > KEEP_SEGMENTS:  # those of these texts stay
            known = {s: p for segments, parts in own for s, p in zip(segments, parts, strict=True) if p is not None}
        known |= {s: p for s, p in found.items() if len(s) <= KEEP_CHARS}
        self._known = known


@lru_cache(maxsize=1)
def aligner(vocabulary_path: str, model_path: str, pattern: str) -> Aligner:
    return Aligner(vocabulary_path, model_path, pattern)


def _stretches(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about STRETCH characters."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= STRETCH:
            yield some
            some, size = [], 0
    if some:
        yield some


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def align(docs: DataFrame, vocabulary_path: str, model_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, ``groups`` and the distinct linked ``pairs`` (a << 32 | b) with how many ``times`` each is linked.

    ``groups`` has each group's ids of A, a bar, its ids of B; ids are joined by commas, groups by semicolons.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in _RESULTS]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())]
    schema = T.StructType([rows.schema["row"], *map(T.StructField, _RESULTS, kinds)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(vocabulary_path, model_path, pattern)
        for batch in batches:
            at = 0
            for texts in _stretches(batch.column(1).to_pylist()):
                numbers, groups, pairs, times = [], [], [], []
                for *counts, text, links in work.texts(texts):
                    numbers.append(counts)
                    groups.append(text)
                    distinct, often = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                    pairs.append(distinct)
                    times.append(often.astype(np.int32))
                columns = [*map(list, zip(*numbers, strict=True)), groups]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(columns, _ARROW_RESULTS[:4], strict=True)), _lists(pairs, pa.int64()), _lists(times, pa.int32())],
                    names=["row", *_RESULTS],
                )
                at += len(texts)

    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in own], *_RESULTS)


def n_links() -> Column:
    """All links of a document of ``align``."""
    return F.aggregate("times", F.lit(0).cast("long"), lambda s, x: s + x)


def score_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum in place of pairs and times.

    A pair counts as often as it is linked in the whole table: count_sum adds that up over
    a document's links, n_best has those whose count is the highest that their id of B has.
    """
    spark = aligned.sparkSession
    own = [c for c in aligned.columns if c not in ("pairs", "times", "n_links", "n_best", "count_sum")]
    rows = aligned.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "pairs", "times")
    numbers = T.ArrayType(T.LongType())
    block_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", rows.schema["row"].dataType), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("pairs", numbers), T.StructField("totals", numbers)])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of each block, coded by a dictionary of its pairs, then the dictionary."""
        number = TaskContext.get().partitionId() << 32

        def block(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(some).combine_chunks()
            own_rows, pairs, times = (held.column(i).combine_chunks() if held.column(i).num_chunks != 1 else held.column(i).chunk(0) for i in range(3))
            flat, often = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            distinct, codes = np.unique(flat, return_inverse=True)
            ends = pa.array(np.cumsum([0, *(x or 0 for x in pc.list_value_length(pairs).to_pylist())]), pa.int32())
            totals = np.bincount(codes, often, len(distinct)).astype(np.int64)
            n = held.num_rows
            of = lambda size: pa.array(np.full(size, number, np.int64))
            none = [pa.nulls(n, pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([of(n), own_rows, pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(often, pa.int32())), *none], names=block_schema.names)
            yield pa.RecordBatch.from_arrays([of(1), pa.nulls(1, own_rows.type), *[pa.nulls(1, pa.list_(pa.int32()))] * 2, _lists([distinct], pa.int64()), _lists([totals], pa.int64())], names=block_schema.names)

        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES or sum(len(b) for b in some) >= BLOCK_ROWS:
                yield from block(some)
                number += 1
                some, size = [], 0
        if some:
            yield from block(some)

    coded = materialize(rows.mapInArrow(blocks, block_schema), "aligned")
    entries = coded.filter(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip("pairs", "totals")).alias("e")).select("block", F.col("e.pairs").alias("pair"), F.col("e.totals").alias("total"))
    counted = materialize(entries.groupBy("pair").agg(F.sum("total").alias("n")), "pair-counts")
    of_b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    counts = counted.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy(of_b))).alias("best"))
    words = entries.select(F.col("block").alias("of"), "pair").join(counts, "pair")
    schema = T.StructType([coded.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum"))])

    def scored(key: tuple, documents: pa.Table, dictionary: pa.Table) -> pa.Table:
        dictionary = dictionary.sort_by("pair")  # codes are places in this order
        count, best = dictionary["n"].to_numpy(), dictionary["best"].to_numpy(zero_copy_only=False).astype(np.int64)
        codes, times = documents["codes"].combine_chunks(), documents["times"].combine_chunks()
        at, often = codes.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum([0, *pc.list_value_length(codes).to_pylist()])
        sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (often, often * best[at], often * count[at])]
        return pa.table([documents["row"], *(pa.array(x, pa.int64()) for x in sums)], names=schema.names)

    documents = coded.filter(F.col("pairs").isNull()).select("block", "row", "codes", "times")
    out = documents.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(scored, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in own], "n_links", "n_best", "count_sum")
