"""A training-data pipeline over ``documents``: quality, near duplicates, contamination, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terradelta.llm import decontaminate, near_copies, packing, quality, secret_scan
from terradelta.llm.queries import packed_pieces, table
from terradelta.llm.tables import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 0.8 of the five-word shingles or more in common."""
    return near_copies.representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, mixed by source."""
    return packed_pieces(packing.pack(docs, ids=False))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_text),
    ("near duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None  # hashes, fingerprints and token ids are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
