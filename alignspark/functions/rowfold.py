"""Scores by built-in functions alone: rows of the table folded one after another, gaps along a row by a prefix maximum.

For short sequences where no Python worker is wanted.  Higher-order functions
are interpreted, so long pairs belong to :func:`alignspark.operators.align.align`;
parameters should be integral where scores are to equal its in every bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignspark.functions import encoding
from alignspark.operators.align import Problem
from alignspark.params import AlignParams

_NONE = -1e300


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_maximum(values: Column) -> Column:
    """The largest value up to each place, by steps of doubling width."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda x, j: F.greatest(x, F.get(acc, j - F.call_function("shiftleft", F.lit(1), k)))))


def _row_gaps(opened: Column, cost: float, extend: float) -> Column:
    """Y of a row: the best earlier cell less the gap from it."""
    from_left = F.transform(opened, lambda v, j: v + j * extend)
    return _let(prefix_maximum(from_left), lambda best: F.transform(best, lambda v, j: F.when(j == 0, _NONE).otherwise(F.get(best, j - 1) - cost - j * extend)))


def fold_scores(pairs: DataFrame, params: AlignParams, mode: str = "global", gap_model: str = "affine") -> DataFrame:
    """(pair_id, score) of pairs (pair_id, seq_a, seq_b).  A null sequence gives a null score; a foreign character fails."""
    Problem(mode, gap_model, "none")
    open_a, ext_a, open_b, ext_b = (float(x) for x in params.gaps[0])
    if gap_model == "linear":
        open_a = open_b = 0.0
    n = len(params.alphabet)
    table = F.array(*(F.lit(float(x)) for x in params.matrices[0].ravel()))
    lit = lambda x: F.lit(float(x))
    coded = pairs.select("pair_id", encoding.encode(F.col("seq_a"), params.alphabet).alias("a"), encoding.encode(F.col("seq_b"), params.alphabet).alias("b"), table.alias("table"))
    places = F.sequence(F.lit(0), F.size("b"))
    first = F.struct(
        F.transform(places, lambda j: F.lit(0.0) if mode != "global" else F.when(j == 0, 0.0).otherwise(_NONE)).alias("m"), F.transform(places, lambda j: lit(_NONE)).alias("x"),
        F.transform(places, lambda j: F.when(j > 0, -(lit(open_a) + j * ext_a)).otherwise(_NONE) if mode == "global" else lit(_NONE)).alias("y"), lit(0.0).alias("best"), F.lit(0).alias("i"),
    )
    top = lambda r, j: F.greatest(F.get(r["m"], j), F.get(r["x"], j), F.get(r["y"], j))

    def diagonal(r: Column, code: Column) -> Column:
        def cell(b: Column, j: Column) -> Column:
            v = top(r, j) + F.get(F.col("table"), code * n + b)
            return F.greatest(v, lit(0.0)) if mode == "local" else v

        return F.concat(F.array(lit(0.0 if mode == "local" else _NONE)), F.transform("b", cell))

    def down(r: Column) -> Column:
        border = lit(_NONE) if mode == "local" else -(lit(open_b) + (r["i"] + 1) * ext_b)
        return F.transform(r["m"], lambda m, j: F.when(j == 0, border).otherwise(F.greatest(F.greatest(m, F.get(r["y"], j)) - open_b - ext_b, F.get(r["x"], j) - ext_b)))

    def row(r: Column, code: Column) -> Column:
        def with_m(m: Column) -> Column:
            def with_x(x: Column) -> Column:
                opened = F.transform(m, lambda v, j: F.greatest(v, F.get(x, j)))

                def with_y(y: Column) -> Column:
                    best = F.greatest(r["best"], F.array_max(m), F.array_max(x), F.array_max(y)) if mode == "local" else r["best"]
                    return F.struct(m.alias("m"), x.alias("x"), y.alias("y"), best.alias("best"), (r["i"] + 1).alias("i"))

                return _let(_row_gaps(opened, open_a, ext_a), with_y)

            return _let(down(r), with_x)

        return _let(diagonal(r, code), with_m)

    def end(r: Column) -> Column:
        if mode == "local":
            return r["best"]
        at_end = top(r, F.size("b"))
        return at_end if mode == "global" else F.greatest(F.array_max(r["m"]), F.array_max(r["x"]), F.array_max(r["y"]))

    return coded.select("pair_id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.aggregate("a", first, row, end)).alias("score"))
