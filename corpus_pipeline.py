"""The corpus pipeline: quality rules, exact and near deduplication, mixing to target weights, and tokens.

Each stage works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import byte_bpe, exact_dedup, near_dup, quality_rules, token_mix
from marlstone.llm.shared import documents, remove, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier rule keep."""
    return quality_rules.drop_low_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the smallest id: SimHash links, verified by whole sets of five-word shingles to be
    of a similarity of 0.8 or more, and what is as similar beyond the bits that SimHash allows."""
    return near_dup.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them: rows repeat where a source is short of its target."""
    return token_mix.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of the ids and of the bytes they decode to."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path(byte_bpe.RANKS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dup", near_stage),
    ("token_mix", mix_stage),
    ("byte_bpe", token_stage),
]

#: SQL can express neither the covariance estimates, nor the fingerprints, nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written to the shared folder and read again.

    A stage's table goes when the next one's is written.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
