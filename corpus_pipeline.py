"""From documents to packed training sequences.

Each stage works on all rows that the one before kept, written as Parquet and
read again: the quality classifier drops documents it rejects, exact dedup keeps
one of equal texts, near dedup one of each near-duplicate group, and packing
returns the pieces of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import exact_dedup, near_dedup, packing, quality
from tallyglass.llm.storage import settle, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.select(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", classify), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("packing", pack)]

#: A fitted classifier decides which rows go, which SQL can't express; tests/llm/test_pipeline.py tests the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
