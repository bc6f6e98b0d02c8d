"""From raw documents to token ids, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and works on every document that the
stage before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hoptrail.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from hoptrail.llm.queries import token_digests
from hoptrail.llm.scratch import materialize

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has."""
    return line_dedup.cut_repeated_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar sets of five-word shingles."""
    return near_dedup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, and digests of the ids and of the decoded bytes."""
    encoded = bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    return token_digests(bpe.decode(encoded.drop("text"), RANKS))


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]
#: The learned rules and the token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
