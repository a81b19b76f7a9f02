"""Consecutive numbers for the rows of a frame, and frames joined by position.

A frame is put in order by a range partitioning and written once, each row with
its partition and its place there; the partitions' sizes, one row each, become
offsets.  No row passes through the driver or through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.sources.storage import materialize

#: The low bits of ``monotonically_increasing_id`` are a row's place in its partition.
_PLACE = (1 << 33) - 1


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def numbered_and_counted(rows: DataFrame, *order: str, name: str = "position") -> tuple[DataFrame, int]:
    """(``rows`` with a column of consecutive numbers from 0, how many there are).

    Numbers follow ``order``; without one they follow the frame's partitions, as
    of files that are read in their order.  Rows that ``order`` does not tell
    apart are numbered in any order.
    """
    part, place, start = (_free(x, [*rows.columns, name]) for x in ("part_", "place_", "start_"))
    ordered = rows.orderBy(*order) if order else rows
    # two runs of one plan may deal rows out differently, so partitions and places are written down
    held = materialize(ordered.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(_PLACE).alias(place)), "numbered")
    sizes = sorted(tuple(r) for r in held.groupBy(part).agg(F.count(F.lit(1))).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, f"{part} int, {start} long"))
    out = held.join(offsets, part).withColumn(name, F.col(place) + F.col(start))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), name), total


def numbered(rows: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``rows`` with consecutive numbers; see :func:`numbered_and_counted`."""
    return numbered_and_counted(rows, *order, name=name)[0]


def zip_frames(seqs_a: DataFrame, seqs_b: DataFrame, order_a: Sequence[str] = (), order_b: Sequence[str] = ()) -> DataFrame:
    """pair_id, seq_a, seq_b: two frames of sequences (their first columns), matched by position.

    Frames of unequal length raise.  ``order_a`` and ``order_b`` name columns
    that put the frames in order; without them their partitions do.
    """
    (a, n), (b, k) = numbered_and_counted(seqs_a, *order_a, name="pair_id"), numbered_and_counted(seqs_b, *order_b, name="pair_id")
    if n != k:
        raise ValueError(f"{n} and {k} sequences cannot be paired")
    first = lambda df, rows, name: df.select("pair_id", F.col(f"`{rows.columns[0]}`").alias(name))
    return first(a, seqs_a, "seq_a").join(first(b, seqs_b, "seq_b"), "pair_id")


def values_by_position(rows: DataFrame, values: Sequence[float], what: str, id_col: str = "pair_id") -> DataFrame:
    """(id, ``what``): one number of a list for each row, in the order of ids, whatever the ids are."""
    numbers, n = numbered_and_counted(rows.select(id_col), id_col)
    if len(values) != n:
        raise ValueError(f"{n} pairs need as many {what}s, not {len(values)}")
    given = rows.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"position long, {what} double")
    return numbers.join(given, "position").select(id_col, what)


def one_each(rows: DataFrame, given: DataFrame, what: str, id_col: str = "pair_id") -> None:
    """Raise unless every id of ``rows`` has exactly one row of ``given`` with a value, and no other id has any."""
    have = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("pairs"))
    others = given.groupBy(id_col).agg(F.count(F.lit(1)).alias("given"), F.count(what).alias("valued"))
    fault = (
        F.when(F.col("pairs").isNull(), F.lit(f"has a {what} but is no pair")).when(F.col("given").isNull() | (F.col("valued") == 0), F.lit(f"has no {what}"))
        .when(F.col("given") > 1, F.lit(f"has more than one {what}"))
    )
    bad = have.join(others, id_col, "full").select(id_col, fault.alias("fault")).where("fault is not null").first()
    if bad is not None:
        raise ValueError(f"pair {bad[0]} {bad[1]}; every pair needs one {what}")
