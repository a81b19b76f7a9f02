import random

import numpy as np
import pytest

from alignspark import AlignParams, SubstMatrix
from alignspark.functions.rowfold import fold_scores
from alignspark.operators.align import Problem, align

PARAMS = AlignParams(SubstMatrix(6 * np.eye(4) - 4, "ACGT"), 4, 2, 5, 1)


@pytest.mark.parametrize("model", ["linear", "affine"])
@pytest.mark.parametrize("mode", ["global", "local", "glocal"])
def test_equals_the_kernel_without_python(spark, mode, model):
    rng = random.Random(2)
    seq = lambda: "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 3, 9, 17])))
    pairs = spark.createDataFrame([(k, seq(), seq()) for k in range(60)], "pair_id long, seq_a string, seq_b string")
    got = fold_scores(pairs, PARAMS, mode, model)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, align(pairs, PARAMS, Problem(mode, model, "none")).collect()))


def test_nulls(spark):
    pairs = spark.createDataFrame([(1, "A", None), (2, None, "A"), (3, "", "")], "pair_id long, seq_a string, seq_b string")
    assert {r.pair_id: r.score for r in fold_scores(pairs, PARAMS).collect()} == {1: None, 2: None, 3: 0.0}
