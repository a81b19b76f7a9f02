import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignspark import AlignParams, SubstMatrix
from alignspark.operators import tiles
from alignspark.operators.align import Problem, align
from alignspark.operators.tiles import align_tiled

PARAMS = AlignParams(SubstMatrix(6 * np.eye(4) - 4, "ACGT"), 4, 2, 5, 1)


def some_pairs(spark, seed, longest=24):
    rng = random.Random(seed)
    rows = []
    for k in range(14):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, longest)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, longest))) if k % 2 else "".join(c for c in a if rng.random() > 0.2) + rng.choice(["", "ACG"])
        rows.append((k * 5, a, b))
    return spark.createDataFrame([*rows, (900, "", ""), (901, "ACGTACGT", ""), (902, "", "ACGTA"), (903, "AAAAAAAAA", "CCCCCC")], "pair_id long, seq_a string, seq_b string")


@pytest.mark.parametrize("mode", ["global", "local", "glocal"])
@pytest.mark.parametrize("model,tile", [("affine", 7), ("linear", 7), ("affine", 100)])
def test_equals_the_kernel(spark, mode, model, tile):
    pairs, p = some_pairs(spark, tile), Problem(mode, model, "none")
    names = ["pair_id", "score", "ops", "start_i", "start_j", "end_i", "end_j"]
    want = sorted(map(tuple, align(pairs, PARAMS, p, ("score", "path")).select(names).collect()))
    assert sorted(map(tuple, align_tiled(pairs, PARAMS, p, ("score", "path"), tile).select(names).collect())) == want


def test_scores_alone(spark):
    pairs = some_pairs(spark, 3)
    got = align_tiled(pairs, PARAMS, Problem("local", "affine", "none"), tile=5)
    assert got.columns == ["pair_id", "score"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, align(pairs, PARAMS, Problem("local", "affine", "none")).collect()))
    assert align_tiled(pairs.where("false"), PARAMS, Problem("local", "affine", "none"), ("score", "path")).count() == 0


def test_faults(spark):
    one = spark.createDataFrame([(1, "AC", None)], "pair_id long, seq_a string, seq_b string")
    with pytest.raises(Exception, match="pair 1: seq_b is null"):
        align_tiled(one, PARAMS)
    with pytest.raises(ValueError, match="one parameter set"):
        align_tiled(one, PARAMS, Problem(band=3))


def test_a_wave_is_dealt_out_and_a_tile_is_small(spark, monkeypatch):
    """A pair of 36,000 letters, by tiles of 6,000: every wave's tiles are separate rows over more than one task."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, 36_000)
    b = np.delete(np.where(rng.random(len(a)) < 0.1, rng.integers(0, 4, len(a)), a), rng.choice(len(a), 300, replace=False))
    text = lambda x: "".join(np.array(list("ACGT"))[x])
    pairs = spark.createDataFrame([(1, text(a), text(b))], "pair_id long, seq_a string, seq_b string")
    parts = []
    filled = tiles._filled

    def seen(ready, *more):
        out = filled(ready, *more)
        parts.append(ready.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("a") * F.length("b")).alias("cells")).collect())
        return out

    monkeypatch.setattr(tiles, "_filled", seen)
    unit = AlignParams(SubstMatrix(np.eye(4) - 1, "ACGT"), 0, 1, 0, 1)
    r = align_tiled(pairs, unit, Problem("global", "linear", "none"), ("score", "path"), 6000).first()
    waves = [w for w in parts if w]
    assert len(waves) == 11 and max(sum(t.n for t in w) for w in waves) == 6 and max(len(w) for w in waves) > 1
    assert max(t.cells for w in waves for t in w) == 36_000_000
    x = y = 0
    cost = 0
    for op, k in r.ops:
        if op == 0:
            cost += int((a[x : x + k] != b[y : y + k]).sum())
        else:
            cost += k
        x, y = x + k * (op != 2), y + k * (op != 1)
    assert (x, y) == (len(a), len(b)) and -cost == r.score
