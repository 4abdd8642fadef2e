"""The corpus pipeline: documents to packed training sequences.

Each stage takes what its predecessor kept, and decides on all of it. All but
the last return the columns of ``documents``; the last returns the pieces of
the documents and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import written
from linkloom.llm.decontaminate import drop_leaks
from linkloom.llm.exact_dedup import drop_copies
from linkloom.llm.packing import pack
from linkloom.llm.parity_join import drop_near_duplicates
from linkloom.llm.quality_cnn import fit_quality, keep_quality
from linkloom.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts only the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard 0.75 join, the one with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("decontaminate", benchmark_copies), ("pack", packed)]

#: The classifier, the alignment and the tokenizer have no SQL form; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
