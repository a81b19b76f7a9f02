"""Alignment of pairs that arrive as a stream: the same operator, stateless, and windowed sums of its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alignspark.operators.align import Problem, align
from alignspark.params import AlignParams


def score_stream(pairs: DataFrame, params: AlignParams, problem: Problem = Problem(), outputs: tuple[str, ...] = ("score",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Align every arriving pair.  ``keep`` names columns (such as event times) that pass through."""
    keyed = pairs.select(F.struct("pair_id", *keep).alias("pair_id"), "seq_a", "seq_b", *(c for c in ("guide_j", "track", "gap_track") if c in pairs.columns))
    out = align(keyed, params, problem, outputs)
    return out.select("pair_id.*", *(c for c in out.columns if c != "pair_id"))


def windowed_scores(scored: DataFrame, time_col: str, window: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Number, sum and best of scores per event-time window; rows later than ``late`` are left out."""
    return (
        scored.withWatermark(time_col, late).groupBy(F.window(time_col, window, slide) if slide else F.window(time_col, window), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"))
    )


def run_to_parquet(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet, exactly once, until no input is left.

    A windowed sum is appended when the watermark has passed its window, once and
    for all; rows that come later than that are left out.
    """
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
