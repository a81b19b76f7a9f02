"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DatetimeType, MapType, NumericType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Arrow batches of this session hold at most ``size`` of data.

    Texts are long: a batch exists in the JVM and, in several forms, in the
    Python worker, and an executor has one of each for every core.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Only in a local session (as in
    tests) where that is unset, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="alignspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: its lineage is cut there.

    Any executor can read the files, so a lost one costs no recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Ids that are sent to every task at most; beyond it texts are joined by shuffle.
BROADCAST_IDS = 500_000
#: Bytes of strings, binaries and arrays that a broadcast frame holds at most.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a frame for broadcast only if it is measured to have at most ``max_rows`` rows and BROADCAST_BYTES of data.

    Beyond that the join stays an ordinary shuffled one.  The frame should be
    cheap to compute or materialized, as it is counted here.
    """
    sized = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name)) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name)), F.lit(0)) for f in df.schema if not isinstance(f.dataType, (NumericType, DatetimeType, BooleanType))]
    wide = sum(sized[1:], sized[0]) if sized else F.lit(0)
    rows, size = df.select(wide.cast("bigint").alias("size")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("size")).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= BROADCAST_BYTES else df


def distinct_texts(documents: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """(id, texts): the distinct texts of the documents that ``ids`` (id) names, one for nearly all; null counts as empty."""
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi").groupBy("id").agg(F.collect_set("text").alias("texts"))


def with_texts(pairs: DataFrame, documents: DataFrame, id_col: str, hub: int) -> DataFrame:
    """``pairs`` (a, b, ...) with texts_a and texts_b, the distinct texts of both documents.

    Only texts of candidates are moved.  The pairs of a document ``b`` with ``hub`` of them or more
    are dealt out by a salt, and its text is sent along as often as needed.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    texts = distinct_texts(documents, ids, id_col)
    often = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= hub).select("b", F.ceil(F.col("k") / hub).cast("int").alias("salts")), "candidate-hubs")
    hubs = broadcast_if_small(often, BROADCAST_IDS)
    of_a = pairs.join(texts.withColumnsRenamed({"id": "a", "texts": "texts_a"}), "a")
    plain = of_a.join(hubs, "b", "left_anti").join(texts.withColumnsRenamed({"id": "b", "texts": "texts_b"}), "b")
    salted = distinct_texts(documents, often.select(F.col("b").alias("id")), id_col).withColumnsRenamed({"id": "b", "texts": "texts_b"}).join(hubs, "b")
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    spread = of_a.join(hubs, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).join(salted, ["b", "salt"])
    names = [*pairs.columns, "texts_a", "texts_b"]
    return plain.select(names).unionByName(spread.select(names))


def let_go(spark: SparkSession) -> None:
    """Let the driver forget finished shuffles, so that executors delete their files before the next step writes its own."""
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; nothing may read the frame any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        drop_path(df.sparkSession, path)
