"""Token frequencies, vocabularies and dictionary encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoptrail.operators import windows
from hoptrail.written import materialize

PAD_ID, OOV_ID, FIRST_ID = 0, 1, 2
#: A vocabulary of at most so many rows is broadcast to the encoding join.
SMALL_ROWS = 1_000_000


def token_counts(tokens: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """Count and first appearance of each token; null tokens don't count."""
    return tokens.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))


def build(counts: DataFrame, token: str, limit: int, by: list[str] | None = None, reserved: tuple[str, ...] = ()) -> DataFrame:
    """token and id: the most frequent ``limit`` tokens, the first seen on ties; ids after pad, oov and the reserved ones.

    Reserved tokens among the top are skipped, so that a vocabulary may hold fewer.
    ``limit`` 0 takes all tokens.
    """
    order = [F.desc("n"), "first_seen", token]
    fresh = ~F.col(token).isin(*reserved) if reserved else F.lit(True)
    first = FIRST_ID - 1 + len(reserved)
    if by:
        ranked = counts.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        top = (ranked.filter(F.col("_k") <= limit) if limit else ranked).filter(fresh)
        return top.withColumn("id", (F.row_number().over(Window.partitionBy(*by).orderBy("_k")) + first).cast("bigint")).select(*by, token, "id")
    if limit:  # the top rows of each task, then of all; only those are numbered
        top = counts.orderBy(*order).limit(limit).filter(fresh)
        return top.select(token, (F.row_number().over(Window.orderBy(*order)) + first).cast("bigint").alias("id"))
    return windows.numbered(counts.filter(fresh), order, "id").select(token, (F.col("id") + first).cast("bigint").alias("id"))


def encode(df: DataFrame, vocabulary: DataFrame, cols: dict[str, str], token: str, small: bool | None = None) -> DataFrame:
    """New columns of ids; tokens that are null or unknown get ``OOV_ID``."""
    if small is None:
        vocabulary = materialize(vocabulary.select(token, "id"), "vocabulary")  # counted and joined
        small = vocabulary.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    for col, out in cols.items():
        v = vocabulary.select(F.col(token).alias("_t"), F.col("id").alias("_id"))
        df = df.join(F.broadcast(v) if small else v, df[col] == F.col("_t"), "left").withColumn(out, F.coalesce("_id", F.lit(OOV_ID)).cast("bigint")).drop("_t", "_id")
    return df
