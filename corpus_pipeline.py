"""A corpus pipeline: documents in, bins of clean documents out.

Each stage takes the documents that the one before it kept, calls one operator
of ``alignspark.llm`` and lets its decisions take effect: documents that the
quality classifier rejects go; of each group of near-duplicates the smallest id
stays; documents that hold a benchmark passage go; personal data is replaced by
its kind; what is left is packed into bins of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alignspark.llm import decontam, near_dedup, packing, pii, quality
from alignspark.llm.common import materialize, small_batches, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the labelled ones among them, accepts."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    small_batches(spark)
    return near_dedup.keep_representatives(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of ten words of a benchmark item."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    small_batches(spark)
    return docs.withColumn("text", pii.redacted(docs["text"]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bins of 4096 tokens."""
    small_batches(spark)
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", packed),
]

#: Classifier and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
