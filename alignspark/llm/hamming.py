"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A vector's code is the sign bits of its entries.  Codes are cut into segments
of about log2(number of codes) - 3 bits, so that a segment value has some eight
codes; an inverted index maps each segment value to codes.  Round by round, queries that are still open probe all values at
distance t from their own: t up to 1 in every segment, then each t in the first
half of the segments and in the others.  A code that none of these rounds met
differs in t + 1 bits or more in each of the h segments that were probed up to
t and in t bits or more in the others: its distance is at least
segments * t + h.  A query closes once its k-th verified distance is below
that.  Only open queries go on, and of what they meet only codes that are no
farther than the k-th best so far; nothing is capped.

Equal codes are one entry with the k + 1 smallest ids behind it (no more can
be among the k nearest by distance and id), so a code that a third of all rows
share is searched once and met once.

Defined results: neighbours are ordered by distance, then id, and exclude the
query's own row; vectors that are null or of another length than ``bits`` have
no code: they are neither neighbours nor do they get any; entries that are null
or NaN count as 0; repeated ids count once, with the smallest code; fewer rows
than k give fewer neighbours.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignspark.llm.common import materialize


def sign_codes(vectors: DataFrame, bits: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): a 64-bit integer whose bit i tells whether entry i is above 0."""
    if not 1 <= bits <= 64:
        raise ValueError("codes have 1 to 64 bits")
    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, bits)
            with np.errstate(invalid="ignore"):
                code = ((v > 0).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.view(np.int64))], names=["id", "code"])

    return src.mapInArrow(run, "id bigint, code bigint").groupBy("id").agg(F.min("code").alias("code"))


def segments(bits: int, rows: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: about log2(rows) - 3 bits, 4 to 20."""
    width = min(max(round(math.log2(max(rows, 2))) - 3, 4), 20, bits)
    n = -(-bits // width)
    edge = [i * bits // n for i in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edge)]


def _values(cuts: list[tuple[int, int]]):
    """(segment, value) of a code in every segment, as an array column."""
    return F.array(*(F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("code", a).bitwiseAND((1 << n) - 1).alias("value")) for s, (a, n) in enumerate(cuts)))


def rounds(cuts: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """([(segment, t), ...] to probe, distance below which every code has been met)."""
    m, widest = len(cuts), max(n for _, n in cuts)
    yield [(s, t) for t in (0, 1) for s in range(m)], 2 * m
    for t in range(2, widest + 1):
        for lo, hi in ((0, -(-m // 2)), (-(-m // 2), m)):
            if lo < hi:
                yield [(s, t) for s in range(lo, hi)], m * t + hi


def _masks(spark, cuts: list[tuple[int, int]], probes: list[tuple[int, int]]) -> DataFrame:
    """(segment, mask): all masks of t bits; their number depends on the segments' width alone."""
    wanted = [(s, t, 1 << cuts[s][1]) for s, t in probes]
    masks = spark.range(1 << max(n for _, n in cuts)).select(F.col("id").alias("mask"), F.bit_count("id").cast("int").alias("t")).where(F.col("t").isin(sorted({t for _, t in probes})))
    return masks.join(F.broadcast(spark.createDataFrame(wanted, "segment int, t int, end bigint")), "t").where("mask < end").select("segment", "mask")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, neighbor_id, distance and rank of the k nearest rows of every query row.

    ``queries`` are rows of the same form; a row never is its own neighbour.
    """
    spark = vectors.sparkSession
    codes = materialize(sign_codes(vectors, bits, id_col, vector_col), "codes")
    # the k + 1 smallest ids of each code: numbered within a hash of the id first, so that no code is numbered in one task
    salted = W.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    near = codes.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    entries = near.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = materialize(entries, "code-entries")
    total = entries.count()
    asked = materialize(sign_codes(queries, bits, id_col, vector_col).withColumnsRenamed({"id": "query_id"}), "query-codes")
    open_ = asked.select("code").distinct().withColumn("bound", F.lit(bits))
    cuts = segments(bits, total)
    index = materialize(entries.select("code", F.size("ids").alias("n"), F.col("ids")[0].alias("low"), F.explode(_values(cuts)).alias("x")).select("code", "n", "low", "x.segment", "x.value"), "segment-index")
    found = None  # (query, code, distance, n, low): the best so far of open queries
    done = None
    for probed, below in rounds(cuts):
        probes = open_.select("code", "bound", F.explode(_values(cuts)).alias("x")).select(F.col("code").alias("query"), "bound", "x.segment", "x.value")
        probes = probes.join(F.broadcast(_masks(spark, cuts, probed)), "segment").select("query", "bound", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        near = (probes.segment == index.segment) & (probes.value == index.value) & (distance <= F.col("bound"))
        met = probes.join(index, near).select("query", "code", distance.alias("distance"), "n", "low").distinct()
        if found is not None:
            met = met.unionByName(found).distinct()
        order = W.partitionBy("query").orderBy("distance", "low")
        best = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
        best = materialize(best, "neighbours")
        closed = best.where((F.col("upto") >= k + 1) & (F.col("distance") < below)).select("query").distinct()
        if below > bits:
            closed = best.select("query").distinct()
        part = best.join(closed, "query", "left_semi").drop("r", "upto")
        done = part if done is None else done.unionByName(part)
        found = best.join(closed, "query", "left_anti").drop("r", "upto")
        # a query of which nothing was met yet is not in best, but still open
        bounds = best.where(F.col("upto") >= k + 1).groupBy(F.col("query").alias("code")).agg(F.min("distance").alias("found"))
        still = open_.join(closed.withColumnRenamed("query", "code"), "code", "left_anti").join(bounds, "code", "left")
        open_ = materialize(still.select("code", F.coalesce("found", "bound").alias("bound")), "open-queries")
        if open_.isEmpty():
            break
    hits = done.join(entries, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    # k + 1 of the smallest ids of k + 1 codes at most
    rows = W.partitionBy("query").orderBy("distance", "neighbor_id")
    hits = hits.withColumn("r", F.row_number().over(rows)).where(F.col("r") <= k + 1).drop("r")
    out = asked.join(hits, asked.code == hits["query"]).where("query_id != neighbor_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbor_id", F.col("distance").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))


#: The same result in DuckDB, by brute force, for k = 10 and vectors of 64 entries.
ORACLE = """
WITH code AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS b FROM embeddings WHERE len(embedding) = 64
), bits AS (
  SELECT vec_id, b[1:32].list_reduce(lambda a, x: a * 2 + x) AS hi, b[33:64].list_reduce(lambda a, x: a * 2 + x) AS lo
  FROM (SELECT vec_id, list_transform(b, lambda x: CAST(x AS BIGINT)) AS b FROM code)
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(bit_count(xor(q.hi, r.hi)) + bit_count(xor(q.lo, r.lo)) AS INTEGER) AS distance
  FROM bits q JOIN bits r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, neighbor_id, distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
WHERE rank <= 10
"""
