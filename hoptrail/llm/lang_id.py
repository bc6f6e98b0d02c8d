"""Language identification by rank-order profiles of character n-grams.

Training counts words per language over all training texts (an aggregation),
then n-grams of 1 to 3 characters within the distinct words, and keeps each
language's ``profile_size`` most frequent n-grams in order. A document's own
most frequent n-grams are compared with every profile by the out-of-place
distance: for each n-gram the difference of its ranks, or ``profile_size`` if
the profile lacks it. The nearest language wins, ties going to the first name.

n-grams lie within words, which are padded with a blank mark; they are exact
numbers of three 21-bit code points, so ties in frequency break alike everywhere.

Defined cases: texts that are null or have no letter are ``und`` with score 0,
and so is every text if there is nothing to learn from; repeated rows get
repeated results; extra columns pass through, result columns replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoptrail.llm.scratch import bounded_batches

_PAD = ord("_")


def letters_only(text: Column) -> Column:
    """Lower-case words with one mark between them and at both ends."""
    return F.regexp_replace(F.concat(F.lit("_"), F.lower(text), F.lit("_")), r"[^\p{L}]+", "_")


def packed_grams(text: str) -> np.ndarray:
    """All n-grams of a marked text, as numbers; those across a mark are left out."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    word = c != _PAD
    out = [c[word]]
    if len(c) > 1:
        pair = c[:-1] << 21 | c[1:]
        out.append(pair[word[:-1] | word[1:]])
    if len(c) > 2:
        triple = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        out.append(triple[word[1:-1]])
    return np.concatenate(out)


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", profile_size: int = 300) -> DataFrame:
    """lang, gram and place (from 0) of each language's most frequent n-grams over all of ``docs``."""
    words = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(F.split(letters_only(F.col(text_col)), "_")).alias("word")).filter("word != ''")
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts, counts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), np.int64)
            for lang in sorted(set(langs.tolist())):
                own = np.flatnonzero(langs == lang)
                parts = [packed_grams(f"_{texts[i]}_") for i in own]
                weight = np.repeat(counts[own], [len(p) for p in parts])
                values, at = np.unique(np.concatenate(parts), return_inverse=True)
                sums = np.zeros(len(values), np.int64)
                np.add.at(sums, at.reshape(-1), weight)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(sums)], names=["lang", "gram", "n"])

    total = counted.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # The limit on the bare row number lets Spark keep that many of a language in each task before it shuffles.
    return total.withColumn("row", place).filter(F.col("row") <= profile_size).select("lang", "gram", (F.col("row") - 1).alias("place"))


def predict(docs: DataFrame, profile_rows: DataFrame, text_col: str = "text", profile_size: int = 300, most_languages: int = 5_000) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1)."""
    bounded_batches(docs.sparkSession)
    rows = profile_rows.limit(most_languages * profile_size + 1).collect()
    if len(rows) > most_languages * profile_size:
        raise ValueError(f"more than {most_languages} languages")
    langs = sorted({r.lang for r in rows})
    known = np.array(sorted({r.gram for r in rows}), np.int64)
    places = np.full((len(known) + 1, len(langs)), -1, np.int32)  # the last row: n-grams that no profile has
    for r in rows:
        places[np.searchsorted(known, r.gram), langs.index(r.lang)] = r.place
    held = docs.sparkSession.sparkContext.broadcast((langs, known, places))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, known, places = held.value
        for batch in batches:
            best, scores = [], []
            for text in batch.column(1).to_pylist():
                found = _nearest(text, langs, known, places, profile_size)
                best.append(found[0])
                scores.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    clean = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), letters_only(F.col(f"`{text_col}`")).alias("letters"))  # no name of the input can clash
    found = clean.mapInArrow(run, T.StructType([clean.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return found.select(*[F.col("row")[c].alias(c) for c in names], "lang_pred", "score")


def _nearest(text: str | None, langs: list[str], known: np.ndarray, places: np.ndarray, size: int) -> tuple[str, float]:
    if not text or text == "_" or not langs:
        return "und", 0.0
    values, counts = np.unique(packed_grams(text), return_counts=True)
    top = values[np.argsort(-counts, kind="stable")[:size]]
    at = np.searchsorted(known, top)
    at[at == len(known)] = 0
    row = np.where(known[at] == top, at, len(known))
    there = places[row]
    distance = np.where(there < 0, size, np.abs(there - np.arange(len(top))[:, None])).sum(axis=0)
    k = int(np.argmin(distance))
    return langs[k], float(max(0.0, 1 - distance[k] / (size * len(top))))
