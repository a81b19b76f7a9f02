"""SQL functions over a parameter set, all on Arrow batches: scores, log Z, gradients as maps to explode, and as table functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from alignspark.operators.align import Problem, encode_all, solve_arrays
from alignspark.params import AlignParams

#: SQL name -> mode and gap model.
SCORES = {
    "nw_score": ("global", "linear"), "sw_score": ("local", "linear"), "glocal_score": ("glocal", "linear"),
    "nw_score_affine": ("global", "affine"), "sw_score_affine": ("local", "affine"), "glocal_score_affine": ("glocal", "affine"),
}


def _solved(a: pa.Array, b: pa.Array, params: AlignParams, problem: Problem, gradient: bool) -> tuple[dict, pa.Array]:
    """(results of the rows without nulls, where each row's result stands)."""
    some = ~(a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False))
    at = pa.array(np.flatnonzero(some))
    (x, bad), (y, worse) = encode_all(a.take(at), params, "the first sequence"), encode_all(b.take(at), params, "the second sequence")
    for fault in (*bad.values(), *worse.values()):
        raise ValueError(fault.lstrip(":, "))
    return solve_arrays(range(len(x)), x, y, params, problem, paths=False, gradient=gradient), pa.array(np.cumsum(some) - 1, mask=~some)


def score_function(params: AlignParams, problem: Problem):
    """A function of two string columns; null if either is null."""

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        found, place = _solved(a, b, params, problem, False)
        return pa.array(found["score"]).take(place)

    return score


def grad_function(params: AlignParams, problem: Problem):
    """The gradient of two string columns as a map from the field's number to its value; null if either is null."""

    @F.arrow_udf("map<int,double>")
    def grad(a: pa.Array, b: pa.Array) -> pa.Array:
        found, place = _solved(a, b, params, problem, True)
        return pa.MapArray.from_arrays(*map(pa.array, found["grad"])).take(place)

    return grad


def gradient_rows_function(params: AlignParams, problem: Problem):
    """A table function of two strings for LATERAL joins: rows (field, value) of their gradient; none if either is null.

    It aligns a pair a call; for many pairs the map of :func:`grad_function`, exploded, costs less.
    """

    class GradientRows:
        def eval(self, a: str, b: str):
            if a is None or b is None:
                return
            found, _ = _solved(pa.array([a], pa.string()), pa.array([b], pa.string()), params, problem, True)
            _, fields, values = found["grad"]
            for field, value in zip(fields.tolist(), values.tolist(), strict=True):
                yield field, value

    return F.udtf(GradientRows, returnType="field int, value double")


def register(spark: SparkSession, params: AlignParams, prefix: str = "") -> list[str]:
    """Register score, ``log_z``, ``grad`` and ``soft_grad`` functions of six problems under a prefix, and table functions ``grad_rows`` and ``soft_grad_rows``; returns their names."""
    names = []
    for name, (mode, model) in SCORES.items():
        for sql, make, grad in ((name, score_function, "none"), (name.replace("score", "log_z"), score_function, "soft"), (name.replace("score", "grad"), grad_function, "hard"), (name.replace("score", "soft_grad"), grad_function, "soft")):
            spark.udf.register(prefix + sql, make(params, Problem(mode, model, grad)))
            names.append(prefix + sql)
        for sql, grad in ((name.replace("score", "grad_rows"), "hard"), (name.replace("score", "soft_grad_rows"), "soft")):
            spark.udtf.register(prefix + sql, gradient_rows_function(params, Problem(mode, model, grad)))
            names.append(prefix + sql)
    return names
