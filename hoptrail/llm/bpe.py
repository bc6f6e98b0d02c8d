"""Byte-level BPE encoding by overlapping chunks, and decoding.

Every text is cut into chunks of ``chunk_chars`` that reach ``overlap_chars`` into
the next one; each is pre-tokenised from its own start and its pre-tokens are
encoded, in any task. The pre-token pattern looks at nothing before a border, so
once two neighbouring chunks share a border inside their overlap they agree from
there on; the pieces are stitched at the first such border. Where an overlap has
none (a pre-token as long as the overlap), the two chunks alone are pre-tokenised
again as one, from the last border before the overlap. A text of one chunk needs
no stitching and stays in its task; chunks of longer texts are rows of their own,
found again by the digest of the text, so that equal texts are encoded once.

Defined cases: a null or empty text has no ids; decoding a null list gives null;
extra columns pass through whatever their names, and the result columns replace
columns of the same name. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.llm.scratch import SALTS, bounded_batches, looked_up, materialize

#: Entries kept by a worker's memory of encoded pre-tokens, and their longest text.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Copies of a long text from which on its rows are dealt over salts.
HOT_COPIES = 64
#: A border this far from a chunk's end is certain: what begins before it can be no contraction that goes on.
LOOKAHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = read_ranks(ranks_path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Encoder:
    """Encodes pre-tokens; made once per Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        # The pattern of the library's encoder takes what it is given as one piece.
        self._encode = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        self.pieces = regex.compile(pattern)
        self._known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        found = np.array(self._encode(piece), "<i4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self._known) >= CACHE_ENTRIES:
                self._known.clear()
            self._known[piece] = found
        return found

    def chunk(self, text: str) -> list[bytes]:
        """The ids of each pre-token of a chunk, as 32-bit integers."""
        pieces = self.pieces.findall(text)
        out = list(map(self._known.get, pieces))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = self._known.get(pieces[k]) or self._ids(pieces[k])
        return out

    def borders(self, text: str) -> np.ndarray:
        """Where pre-tokens begin, and the end."""
        return np.fromiter((*(m.start() for m in self.pieces.finditer(text)), len(text)), np.int64)


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


@dataclass
class Chunk:
    """A pre-tokenised piece of a text: its place, its borders in the text's offsets, and where the ids of each pre-token end."""

    at: int
    text: str
    borders: np.ndarray
    ends: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, at: int, text: str, enc: Encoder) -> Chunk:
        parts = enc.chunk(text)
        return cls(at, text, enc.borders(text) + at, np.cumsum([0, *(len(p) // 4 for p in parts)]), np.frombuffer(b"".join(parts), "<i4"))

    def between(self, first: int, last: int) -> bytes:
        return self.ids[self.ends[first] : self.ends[last]].tobytes()


def stitch(chunks: list[Chunk], enc: Encoder) -> bytes:
    """Ids of the text that overlapping chunks, in order, cover."""
    out: list[bytes] = []
    now, begin, k, joined = chunks[0], 0, 1, 1  # begin: the first pre-token of the current chunk that counts
    while k < len(chunks):
        later = chunks[k]
        mine = now.borders[begin:-1]
        sure = mine[(mine > later.at) & (mine <= now.at + len(now.text) - LOOKAHEAD)]
        common = np.intersect1d(sure, later.borders[:-1], assume_unique=True)
        if len(common):
            out.append(now.between(begin, int(np.searchsorted(now.borders, common[0]))))
            now, begin, k, joined = later, int(np.searchsorted(later.borders, common[0])), k + 1, 1
            continue
        # No shared border: these chunks become one from the last border before the overlap on. A pre-token over
        # many chunks takes twice as many each time, so that its length is gone through about twice.
        cut = max(begin, int(np.searchsorted(now.borders, later.at, side="right")) - 1)
        out.append(now.between(begin, cut))
        start = int(now.borders[cut])
        parts, reach = [now.text[start - now.at :]], now.at + len(now.text)
        for more in chunks[k : k + joined]:
            parts.append(more.text[max(0, reach - more.at) :])
            reach = max(reach, more.at + len(more.text))
        now, begin, k, joined = Chunk.of(start, "".join(parts), enc), 0, k + joined, joined * 2
    out.append(now.between(begin, len(now.ends) - 1))
    return b"".join(out)


def _reshaped(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "ids",
    chunk_chars: int = 65_536,
    overlap_chars: int = 1_024,
) -> DataFrame:
    """``docs`` with ``ids_col``: the token ids of every whole text."""
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c != ids_col]
    place = own.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))  # no name of the input can clash
    ids_field = T.StructField("ids", T.ArrayType(T.IntegerType()))
    text = F.col("row")[text_col]
    many = F.coalesce(F.char_length(text), F.lit(0)) > chunk_chars

    def one_chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(0).field(place).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([b"".join(enc.chunk(t)) if t else b"" for t in texts])], names=["row", "ids"])

    single = rows.filter(~many).mapInArrow(one_chunk, T.StructType([rows.schema["row"], ids_field]))

    # Chunks of texts of several, spread over all tasks, then joined again for each text.
    long = materialize(rows.filter(many).withColumn("digest", F.sha2(text, 256)), "long-texts")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = list(range(0, len(text), chunk_chars))
                for some in (at[i : i + 64] for i in range(0, len(at), 64)):
                    yield pa.RecordBatch.from_pydict({"digest": [digest] * len(some), "at": some, "rest": [text[a : a + chunk_chars + overlap_chars] for a in some]}, schema=pa.schema([("digest", pa.string()), ("at", pa.int64()), ("rest", pa.string())]))

    def pre_tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Borders of each chunk's pre-tokens and their ids, from an arbitrary start."""
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for digest, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = Chunk.of(at, text, enc)
                yield pa.RecordBatch.from_pydict({"digest": [digest], "at": [at], "rest": [text], "borders": [c.borders], "ends": [c.ends], "ids": [c.ids]}, schema=pa.schema([("digest", pa.string()), ("at", pa.int64()), ("rest", pa.string()), ("borders", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("ids", pa.list_(pa.int32()))]))

    def join_chunks(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        numbers = (table[c].to_numpy() for c in ("borders", "ends", "ids"))
        chunks = [Chunk(*x) for x in zip(table["at"].to_pylist(), table["rest"].to_pylist(), *numbers, strict=True)]
        return pa.table({"digest": pa.array([key[0].as_py()], pa.string()), "ids": _lists([stitch(chunks, encoder(ranks_path, pattern))])})

    pieces = long.select("digest", F.col("row")[text_col].alias("rest")).mapInArrow(cut, "digest string, at long, rest string").dropDuplicates(["digest", "at"])
    encoded = pieces.mapInArrow(pre_tokenise, "digest string, at long, rest string, borders array<long>, ends array<long>, ids array<int>")
    stitched = materialize(encoded.groupBy("digest").applyInArrow(join_chunks, "digest string, ids array<int>"), "stitched")
    # A text may be that of many rows: those are dealt over salts, for which the ids of such texts alone are copied. Ids are never
    # broadcast, since a row of them is as long as its text; the digests of such texts are.
    hot = materialize(long.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_COPIES).select("digest", F.lit(True).alias("hot")), "hot-texts")
    dealt = looked_up(long, hot, ["digest"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    every = looked_up(stitched, hot, ["digest"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    out = single.unionByName(dealt.select("row", "digest", "salt").join(every.select("digest", "salt", "ids"), ["digest", "salt"]).select("row", "ids"))
    return out.select(*[F.col("row")[c].alias(c) for c in own], F.col("ids").alias(ids_col))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``: the bytes of the ids' tokens, joined."""
    schema = _reshaped(df, bytes_col, T.BinaryType())
    names = schema.fieldNames()[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(ranks_path).__getitem__
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).tolist()
            out, at = [], 0
            for size in pc.list_value_length(lists).to_pylist():
                if size is None:
                    out.append(None)
                else:
                    out.append(b"".join(map(token, values[at : at + size])))
                    at += size
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(out, pa.binary())], names=[*names, bytes_col])

    return df.mapInArrow(run, schema)
