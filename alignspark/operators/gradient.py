"""Reductions over per-pair results: totals, summed and weighted gradients, dense export."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignspark.functions import render
from alignspark.params import AlignParams

#: Rows of one block of an ordered sum.
ORDERED_BLOCK = 4096


def gradient_rows(results: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, field, value): one row a parameter that the gradient touches."""
    return results.select(id_col, F.explode("grad").alias("field", "value"))


def field_names(params: AlignParams, field: Column) -> Column:
    """The readable form of a field's number: set, then the two symbols or the gap field."""
    n, symbols = len(params.alphabet), params.alphabet.symbols
    inner = F.pmod(field, F.lit(params.n_fields))
    gap = F.element_at(F.array(*map(F.lit, ("gap_open_a", "gap_extend_a", "gap_open_b", "gap_extend_b"))), F.greatest(inner - n * n, F.lit(0)).cast("int") + 1)
    pair = F.concat(F.substring(F.lit(symbols), F.floor(inner / n).cast("int") + 1, F.lit(1)), F.substring(F.lit(symbols), F.pmod(inner, F.lit(n)).cast("int") + 1, F.lit(1)))
    return F.concat(F.floor(field / params.n_fields).cast("string"), F.lit("."), F.when(inner < n * n, pair).otherwise(gap))


def summed(results: DataFrame) -> DataFrame:
    """(field, value): the gradient summed over all rows; sums are formed before the shuffle."""
    return results.select(F.explode("grad").alias("field", "value")).groupBy("field").agg(F.sum("value").alias("value"))


def weighted(results: DataFrame, weights: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(field, value): the gradient summed with a weight a pair (``weights``: id, weight)."""
    rows = results.select(id_col, "grad").join(weights.select(id_col, "weight"), id_col)
    return rows.select("weight", F.explode("grad").alias("field", "v")).groupBy("field").agg(F.sum(F.col("weight") * F.col("v")).alias("value"))


def summed_in_order(results: DataFrame, ordinal: str = "pair_id") -> DataFrame:
    """(field, value): the same sum in a fixed order - blocks of 4096 ordinals, then the blocks - whatever the partitioning."""
    in_order = lambda xs: F.aggregate(F.transform(F.array_sort(xs), lambda x: x["v"]), F.lit(0.0), lambda a, v: a + v)
    rows = results.select(F.col(ordinal).alias("o"), F.explode("grad").alias("field", "v"))
    blocks = rows.groupBy("field", F.floor(F.col("o") / ORDERED_BLOCK).alias("block")).agg(in_order(F.collect_list(F.struct("o", "v"))).alias("v"))
    spans = blocks.groupBy("field", F.floor(F.col("block") / ORDERED_BLOCK).alias("span")).agg(in_order(F.collect_list(F.struct("block", "v"))).alias("v"))
    return spans.groupBy("field").agg(in_order(F.collect_list(F.struct("span", "v"))).alias("value"))


def to_params(rows: DataFrame, like: AlignParams) -> AlignParams:
    """Bring a summed gradient to the driver: at most as many rows as there are parameters."""
    values = np.zeros(like.num_sets * like.n_fields)
    for field, value in rows.select("field", "value").collect():
        values[field] = value
    return like.like_flat(values)


def dense(results: DataFrame, params: AlignParams, id_col: str = "pair_id") -> DataFrame:
    """(id, matrix_grad, gap_grad): every pair's gradient as full arrays, sets one after another."""
    n, fields = len(params.alphabet), params.n_fields
    at = lambda k: F.coalesce(F.try_element_at("grad", k.cast("int")), F.lit(0.0))
    part = lambda lo, hi: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(params.num_sets - 1)), lambda s: F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda f: at(s * fields + f))))
    return results.select(id_col, part(0, n * n).alias("matrix_grad"), part(n * n, fields).alias("gap_grad"))


def total(results: DataFrame) -> float:
    """The sum of scores; 0 of no rows."""
    return float(results.agg(F.sum("score")).first()[0] or 0.0)


def path_fields(paths: DataFrame, params: AlignParams, *keys: str, gap_model: str = "affine") -> DataFrame:
    """(keys, field, value): what best paths count of each parameter, from their runs alone.

    ``paths`` has seq_a, seq_b, ops, start_i and start_j, and track and gap_track
    where there are several sets.  Runs become rows, each with the fields that it
    counts; sums are formed before the shuffle.  Without ``keys`` it is the summed
    gradient.
    """
    n, fields = len(params.alphabet), params.n_fields
    symbols = F.lit(params.alphabet.symbols)
    cols = [*keys, "seq_a", "seq_b", "ops", *(c for c in ("track", "gap_track") if c in paths.columns)]
    at = render.coordinates(F.col("ops"), F.col("start_i"), F.col("start_j"))
    placed = paths.where(F.size("ops") > 0).withColumn("at", at).select(*cols, F.col("at.a").alias("at_a"), F.col("at.b").alias("at_b"))
    runs = placed.select(*cols, F.posexplode("ops").alias("k", "run"), "at_a", "at_b")
    runs = runs.withColumns({"op": F.col("run.op"), "len": F.col("run.len"), "i": F.get("at_a", F.col("k")), "j": F.get("at_b", F.col("k"))})
    zero = F.lit(0)
    of_row = (lambda i: F.coalesce(F.get("track", i), zero)) if "track" in cols else (lambda i: zero)
    # a gap in A lies between two rows; by default it takes the set of the row above it
    above = of_row(F.greatest(F.col("i") - 1, zero))
    of_gap = F.coalesce(F.get("gap_track", F.col("i")), above) if "gap_track" in cols else above
    letters = lambda seq, first: F.split(F.substring(seq, F.col(first) + 1, F.col("len")), "")
    runs = runs.withColumns({"la": letters("seq_a", "i"), "lb": letters("seq_b", "j"), "steps": F.sequence(zero, F.col("len") - 1)})
    entry = lambda s, field, v: F.struct((s * fields + field).cast("int").alias("field"), v.cast("double").alias("value"))
    symbol = lambda c: F.position(c, symbols) - 1
    pairs = F.transform("steps", lambda s: entry(of_row(F.col("i") + s), symbol(F.get("la", s)) * n + symbol(F.get("lb", s)), F.lit(1.0)))
    in_b = F.transform("steps", lambda s: entry(of_row(F.col("i") + s), F.lit(n * n + 3), F.lit(-1.0)))
    in_a = F.array(entry(of_gap, F.lit(n * n + 1), -F.col("len")))
    if gap_model == "affine":
        in_b = F.concat(in_b, F.array(entry(of_row(F.col("i")), F.lit(n * n + 2), F.lit(-1.0))))
        in_a = F.concat(in_a, F.array(entry(of_gap, F.lit(n * n), F.lit(-1.0))))
    counted = runs.select(*keys, F.explode(F.when(F.col("op") == 0, pairs).when(F.col("op") == 1, in_b).otherwise(in_a)).alias("x"))
    return counted.groupBy(*keys, F.col("x.field").alias("field")).agg(F.sum("x.value").alias("value"))
