"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm.exactdup import without_exact_duplicates
from tablegauge.llm.mixing import mix_sources
from tablegauge.llm.neardup import without_near_duplicates
from tablegauge.llm.packing import packed_sequences
from tablegauge.llm.quality import fit_quality, quality_scores
from tablegauge.llm.queries import tokenizer_path
from tablegauge.llm.shared import Work

# SQL has neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the table ``labels``, does not reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, model, keep_columns=True)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return without_exact_duplicates(docs)


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return without_near_duplicates(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for: not at all, or up to three times."""
    return mix_sources(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences of 2048 tokens."""
    return packed_sequences(docs, tokenizer_path())


STAGES = [
    ("quality", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", different_documents),
    ("mixing", mixed_documents),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{n}")
        if n:
            work.drop(f"stage{n - 1}")
    return docs
