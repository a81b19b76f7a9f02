"""Quality classifier: zstandard dictionaries of good and of bad text, compared by compressed size.

Each text is compressed in blocks of 2 KiB, once with a dictionary trained on
good text and once with one trained on bad text.  The score is the difference of
the two sizes over the text's own size, wb * bad - wg * good, through a logistic
curve.  The weights of the two sizes are fitted with the curve on labelled texts
that trained neither dictionary, as one dictionary helps any text more than the
other does.  Blocks keep the dictionary's influence alike in short and long
texts; every byte of a text counts.

Training uses a bounded sample of the labelled rows: ``sample_docs`` a class at
most, the first by a hash of the id, half for the dictionaries (``sample_blocks``
blocks at most a class), half for the curve.  Scoring covers every row in one
Arrow pass without a shuffle.

Defined results: null and empty texts are scored as texts of no bytes; a label
other than 0 or 1, or null, is ignored; a document labelled twice counts once,
by its higher label; with no labelled rows of a class every score is the share
of label 1 (0.5 where there are none); repeated documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.llm.common import drop_path, new_path

BLOCK = 2048
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the curve's weights (bias, size with the bad one, size with the good one)."""

    bad: bytes
    good: bytes
    weights: tuple[float, float, float]


_coders: dict[tuple[bytes, bytes], tuple] = {}


def _coder(content: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(content, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(bad: bytes, good: bytes, text: str | None) -> tuple[float, float]:
    """(size with the bad dictionary / bytes, size with the good one / bytes) of a whole text."""
    if (bad, good) not in _coders:
        _coders.clear()
        _coders[bad, good] = (_coder(bad), _coder(good))
    by_bad, by_good = _coders[bad, good]
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = g = 0
    for i in range(0, max(len(raw), 1), BLOCK):
        block = raw[i : i + BLOCK]
        b += len(by_bad.compress(block))
        g += len(by_good.compress(block))
    n = max(len(raw), 1)
    return b / n, g / n


def train_dictionary(blocks: list[bytes], size: int = 112_640) -> bytes:
    """A trained dictionary; of few blocks, the blocks themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Logistic weights on the two sizes, by Newton steps on their standardized difference and sum."""
    turned = np.c_[x[:, 0] - x[:, 1], x[:, 1]]  # the sizes go up and down together: these two hardly do
    mean, spread = turned.mean(0), turned.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (turned - mean) / spread]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3), a.T @ (y - p) - ridge * w)
    gap, good = w[1] / spread[0], w[2] / spread[1]
    return float(w[0] - gap * mean[0] - good * mean[1]), float(gap), float(good - gap)


def scores(model: QualityModel, texts) -> tuple[np.ndarray, np.ndarray]:
    """(probability of label 1, the two sizes) of each text."""
    x = np.array([sizes(model.bad, model.good, t) for t in texts], float).reshape(-1, 2)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -35, 35))), x


def training_rows(labels: DataFrame, sample_docs: int) -> DataFrame:
    """(doc_id, quality, half): the sampled labelled rows, none of the held-out fifth."""
    rows = (
        labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    return (
        rows.where("quality = 0").orderBy("h", "doc_id").limit(sample_docs)
        .unionByName(rows.where("quality = 1").orderBy("h", "doc_id").limit(sample_docs))
        .select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"))
    )


def fit_quality(documents: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_blocks: int = 4000) -> QualityModel:
    spark = documents.sparkSession
    picked = training_rows(labels, sample_docs)  # at most 2 * sample_docs rows: small enough to send everywhere
    path = new_path(spark, "quality-sample")
    documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").write.parquet(path)
    sample = spark.read.parquet(path)

    @F.pandas_udf("array<binary>")
    def blocks_of(texts):
        raw = (t.encode("utf-8", "surrogatepass") if t else b"" for t in texts)
        import pandas as pd

        return pd.Series([[r[i : i + BLOCK] for i in range(0, len(r), BLOCK)] for r in raw])

    blocks = sample.where("half = 0").select("quality", F.explode(blocks_of("text")).alias("block")).withColumn("h", F.xxhash64("block"))
    dictionaries = [train_dictionary([bytes(r[0]) for r in blocks.where(F.col("quality") == q).orderBy("h").limit(sample_blocks).select("block").collect()]) for q in (0, 1)]
    bad, good = dictionaries
    if not bad or not good:
        share = sample.agg(F.avg("quality")).first()[0]
        share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        drop_path(spark, path)
        return QualityModel(bad or b" ", good or b" ", (float(np.log(share / (1 - share))), 0.0, 0.0))

    @F.pandas_udf("array<double>")
    def figures(texts):
        import pandas as pd

        return pd.Series([list(sizes(bad, good, t)) for t in texts])

    rows = sample.where("half = 1").select("quality", figures("text").alias("x")).collect()  # bounded by sample_docs
    y = np.array([r[0] for r in rows], float)
    drop_path(spark, path)
    if len(rows) < 4 or y.min() == y.max():  # nothing to calibrate on: the plain difference
        return QualityModel(bad, good, (0.0, 1.0, -1.0))
    return QualityModel(bad, good, fit_curve(np.array([r[1] for r in rows]), y))


def score_quality(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id, score (probability of label 1), predicted (1 if score >= threshold) and the two size figures of every row."""
    src = documents.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, x = scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x[:, 0]), pa.array(x[:, 1])], names=[id_col, "score", "predicted", "size_bad", "size_good"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, size_bad double, size_good double")


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier accepts, with the columns that they came with."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(model, texts.to_pylist())[0])

    return documents.where(score(F.col("text").cast("string")) >= threshold)
