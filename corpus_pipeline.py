"""The corpus pipeline: quality rules, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Each works on all rows that its predecessor kept.  Rows that a stage rejects go; what it removes from texts (boilerplate
lines, secrets) is gone from then on, and ``n_chars`` follows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import language_id, packing, quality_rules, secret_scan, simhash
from voxloom.llm.common import shared_dir, table, written

#: The stages cut, filter, link and pack by methods that SQL doesn't express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the rules, and removes boilerplate lines from the others."""
    return quality_rules.clean(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told."""
    return language_id.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group."""
    return simhash.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secret_scan.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("language_id", language), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
