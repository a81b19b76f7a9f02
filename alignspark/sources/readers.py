"""Sources and sinks of sequences and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pairs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, seq_a, seq_b of lines ``a<TAB>b``.  Ids are unique, not consecutive."""
    lines = spark.read.schema("seq_a string, seq_b string").option("sep", "\t").option("quote", "").csv(path)
    return lines.select(F.monotonically_increasing_id().alias("pair_id"), F.coalesce("seq_a", F.lit("")).alias("seq_a"), F.coalesce("seq_b", F.lit("")).alias("seq_b"))


def write_pairs_tsv(pairs: DataFrame, path: str) -> None:
    pairs.select("seq_a", "seq_b").write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence of FASTA files; a record is one row, read in parallel."""
    records = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return records.select(
        F.substring_index(F.trim(head), " ", 1).alias("name"), F.trim(head).alias("description"),
        F.regexp_replace(body, r"\s", "").alias("sequence"),
    )


def zip_pairs(spark: SparkSession, seqs_a: Sequence[str], seqs_b: Sequence[str]) -> DataFrame:
    """pair_id, seq_a, seq_b of two lists in the driver, matched by position."""
    if len(seqs_a) != len(seqs_b):
        raise ValueError(f"{len(seqs_a)} and {len(seqs_b)} sequences cannot be paired")
    return spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(zip(seqs_a, seqs_b, strict=True))], "pair_id long, seq_a string, seq_b string")


def with_flat_tracks(pairs: DataFrame, flat: DataFrame, name: str = "track", id_col: str = "pair_id") -> DataFrame:
    """Add a track column from one row a residue: (pair_id, position, set)."""
    rows = flat.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("position", "set"))).alias("entries"))
    return pairs.join(rows.select(id_col, F.transform("entries", lambda x: x["set"].cast("int")).alias(name)), id_col, "left")


def write_results(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
