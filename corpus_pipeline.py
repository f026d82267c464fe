"""From documents to packed training sequences in five stages, each of which reads what the one before has kept.

Every stage is a function of ``(spark, docs, sf_dir)``; all but the last return rows of ``docs`` with the columns they came with. Rows are told apart by ``doc_id`` and text:
exact deduplication leaves one row of every text, so ids may still be null or stand for several texts in all stages after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simloom.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from simloom.llm.queries import tokenizer_file
from simloom.llm.shared import materialized, table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored 0.7 or more by a model trained on the labels of those that are there."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest id of texts that are equal but for the case of A-Z."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every class of near-duplicates, with its smallest id."""
    return near_dedup.without_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, whole or with a few edits."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# The learned scores of the first stage have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
