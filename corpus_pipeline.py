"""From raw documents to packed training sequences: quality, language, near-duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import langid, mixing, neardup, packing, quality
from sitelens.llm.store import settle
from sitelens.llm.text import bucket

#: Vocabulary file of the packing stage, present on every executor.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the additive model, fitted on the labelled ones, scores at 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(bucket("doc_id", 4) != 2))
    return quality.accepted(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which the byte network finds one of the languages it learned from them."""
    return langid.accepted(docs, langid.train(docs.filter(bucket("doc_id", 4) != 2)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates (five-word shingles, similarity 0.8)."""
    return neardup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as the target of its source asks for."""
    return mixing.emitted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, dealt to sequences of 1024 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifiers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
