"""The corpus pipeline: reject, deduplicate, mix and pack the documents.

Each stage takes the session, the documents that the stage before has kept, and the folder of the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lines, mixing, packing, quality, simhash
from tidemark.llm.common import table
from tidemark.llm.queries import WORD_TOKENIZER
from tidemark.session import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker accepts."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the three-line windows that occurred before."""
    return lines.replaced(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 token ids."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("quality", keep_quality),
    ("line-dedup", drop_repeated_lines),
    ("near-dedup", keep_distinct),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
