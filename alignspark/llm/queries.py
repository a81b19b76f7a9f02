"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm import decontam, filter_audit, hamming, licenses, multiset, near_dedup, packing, pii, quality, spelling, substring, token_store, tokens
from alignspark.llm.common import new_path, small_batches, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; the held-out fifth trains nothing."""
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.score_quality(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 4096 tokens."""
    small_batches(spark)
    return tokens.token_counts(table(spark, sf_dir, "documents"), limit=4096)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on shingles of two words."""
    small_batches(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    small_batches(spark)
    return pii.detect(table(spark, sf_dir, "documents")).drop("scored")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in a content-addressed store, read back and verified."""
    small_batches(spark)
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that other documents hold, too."""
    small_batches(spark)
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings, by sign bits, of every hundredth embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, bits=64)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 4096 tokens."""
    small_batches(spark)
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document: its own statement's, or that of the nearest directory with a licence file."""
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", licenses.document_path())


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return multiset.edit_report(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, for each source, in every order of application."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and the frequent words that they are variants of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_pii": op5_pii,
    "op6_token_store": op6_token_store,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_top_k": op8_top_k,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
    "op11_fingerprints": op11_fingerprints,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontam.ORACLE,
    "op8_top_k": hamming.ORACLE,
    "op10_licenses": licenses.oracle(),
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_spelling_variants": spelling.oracle(),
}
