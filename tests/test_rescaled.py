"""Rescaled sums over all paths against sums in logarithms, and the bound on what they lose."""

import itertools

import numpy as np
import pytest

from alignspark.operators.align import WAYS, Problem, align, solve_arrays
from alignspark.operators.batch import PairBatch, PairBatchFloat32
from alignspark.params import AlignParams, SubstMatrix
from alignspark.plans import kernel as kn

PARAMS = AlignParams(SubstMatrix(6 * np.eye(4) - 4, "ACGT"), 4, 2, 3, 1)
TABLES = kn.TABLE_BYTES


def codes(rng, count, least, most):
    return [rng.integers(0, 4, n).astype(np.uint8) for n in rng.integers(least, most, count)]


def both(a, b, problem, params=PARAMS, posterior=False, **given):
    rest = (given.get("guides"), given.get("tracks"), given.get("gap_tracks"), posterior)
    out = []
    for impl in ("log", problem.soft_impl):
        p = Problem(problem.mode, problem.gap_model, "soft", problem.precision, problem.temperature, problem.band, posterior, impl, "double" if impl == "log" else problem.soft_precision)
        out.append(solve_arrays(range(len(a)), a, b, params, p, *rest))
    return out


def dense(found, pairs, fields):
    edges, key, value = found["grad"]
    out = np.zeros((pairs, fields))
    out[np.repeat(np.arange(pairs), np.diff(edges)), key] = value
    return out


@pytest.mark.parametrize("mode,model", list(itertools.product(kn.MODES, kn.MODELS)))
@pytest.mark.parametrize("marks", [False, True])
def test_rescaled_sums_equal_logarithms(mode, model, marks, monkeypatch):
    monkeypatch.setattr(kn, "TABLE_BYTES", 1 << 12 if marks else TABLES)
    rng = np.random.default_rng(7)
    a, b = codes(rng, 9, 60, 130), codes(rng, 9, 60, 150)
    for band, temperature, posterior in ((0, 1.0, False), (25, 0.5, False), (0, 1.0, True)):
        logs, scaled = both(a, b, Problem(mode, model, "soft", temperature=temperature, band=band, soft_impl="scaled"), posterior=posterior)
        assert {WAYS[w] for w in scaled["way"]} == {"float64"} and not scaled["refused"]
        assert scaled["score"] == pytest.approx(logs["score"], rel=1e-12)
        assert np.abs(dense(scaled, 9, 20) - dense(logs, 9, 20)).max() < 1e-9
        if posterior:  # ties aside
            assert np.mean(scaled["guide"][1] != logs["guide"][1]) < 0.01


def test_rescaled_sums_of_tracked_pairs():
    rng = np.random.default_rng(8)
    a, b = codes(rng, 6, 70, 110), codes(rng, 6, 70, 110)
    two = AlignParams.stack([PARAMS, PARAMS * 0.5])
    tracks, gaps = [rng.integers(0, 2, len(x)) for x in a], [rng.integers(0, 2, len(x) + 1) for x in a]
    logs, scaled = both(a, b, Problem("global", "affine", "soft", soft_impl="scaled"), two, tracks=tracks, gap_tracks=gaps)
    assert scaled["score"] == pytest.approx(logs["score"], rel=1e-12) and np.abs(dense(scaled, 6, 40) - dense(logs, 6, 40)).max() < 1e-9


def test_floats_come_first_and_refuse_what_they_would_lose():
    rng = np.random.default_rng(9)
    a, b = codes(rng, 12, 20, 120), codes(rng, 12, 20, 120)
    for temperature, expected in ((1.0, {"float32"}), (0.05, {"plain", "float64", "log"}), (0.001, {"log"})):
        logs, floats = both(a, b, Problem("local", "affine", "soft", "float32", temperature, soft_precision="float32", soft_impl="scaled_or_log"))
        ways = {WAYS[w] for w in floats["way"]}
        assert ways <= expected and ways
        assert floats["score"] == pytest.approx(logs["score"], rel=1e-6)
        assert np.abs(dense(floats, 12, 20) - dense(logs, 12, 20)).max() < (1e-3 if "float32" in ways else 1e-8)
    with pytest.raises(ValueError, match="needs precision='float32'"):
        Problem(grad="soft", soft_precision="float32")


def steep_pairs():
    """Pair 0 fits; what pair 1 matches first weighs e^672 more than anything that follows."""
    u, w, x = np.array([2, 3, 3, 2] * 8, np.uint8), np.array([0, 1, 1, 1] * 8, np.uint8), np.array([1, 0, 0, 1] * 8, np.uint8)
    return [u, np.concatenate([u, w])], [np.concatenate([x, u])] * 2


STEEP = AlignParams(SubstMatrix(31 * np.eye(4) - 10, "ACGT"), 0, 1, 0, 21)


def test_pairs_beyond_the_bound_go_to_logarithms_or_are_refused():
    a, b = steep_pairs()
    logs, chosen = both(a, b, Problem("glocal", "linear", "soft", soft_impl="scaled_or_log"), STEEP)
    assert [WAYS[w] for w in chosen["way"]] == ["float64", "log"] and chosen["score"] == pytest.approx(logs["score"], rel=1e-12)
    assert np.abs(dense(chosen, 2, 20) - dense(logs, 2, 20)).max() < 1e-9
    _, strict = both(a, b, Problem("glocal", "linear", "soft", soft_impl="scaled"), STEEP)
    assert list(strict["refused"]) == [1] and "64 by 64 letters" in strict["refused"][1]


def test_the_bound_covers_what_is_really_lost():
    """Rescaled sums are as near to logarithms as the bound says, for pairs on either side of it."""
    rng = np.random.default_rng(10)
    for temperature in (0.5, 0.2, 0.1, 0.05, 0.03):
        p = Problem("glocal", "affine", "soft", temperature=temperature)
        s = p.scoring(PARAMS)
        a, b = codes(rng, 8, 90, 91), codes(rng, 8, 110, 111)
        block = kn.Block(kn.pad(a, 90, np.uint8), kn.pad(b, 110, np.uint8), np.full(8, 90), np.full(8, 110))
        true, _, _, _ = kn.forward_backward(block, s, True, way="log")
        got, _, _, sound = kn.forward_backward(block, s, True, way="float64")
        assert np.abs(got - true)[sound].max(initial=0) < 1e-12 * np.abs(true).max()
        total, _, _, alone = kn.forward_backward(block, s, False, way="float64")
        assert (alone >= sound).all() and np.abs(total - true)[alone].max(initial=0) < 1e-12 * np.abs(true).max()


def test_ways_and_refusals_of_frames(spark):
    letters = np.array(list("ACGT"))
    a, b = steep_pairs()
    rows = [(k, "".join(letters[x]), "".join(letters[y])) for k, (x, y) in enumerate(zip(a, b, strict=True))] + [(2, "", ""), (3, "ACGT", "ACCT"), (4, None, "A")]
    pairs = spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string")
    problem = Problem("glocal", "linear", "soft", soft_impl="scaled")
    got = {r.pair_id: r for r in align(pairs, STEEP, problem, ("score", "grad", "way"), on_error="null").collect()}
    assert [got[k].way for k in (0, 2, 3)] == ["float64", "plain", "plain"]
    assert got[1].score is None and "rescaled sums may lose more than 2^-45" in got[1].error and "null" in got[4].error
    with pytest.raises(Exception, match="pair 1: 64 by 64 letters"):
        align(pairs.where("pair_id < 2"), STEEP, problem, ("score", "grad")).collect()
    with pytest.raises(ValueError, match="have a way"):
        align(pairs, STEEP, Problem("glocal", "linear", "none"), ("score", "way"))


def test_batches_take_floats_only_where_scores_are_floats(spark):
    pairs = spark.createDataFrame([(1, "ACGT" * 20, "ACCT" * 20), (2, "GATTACA", "GATTAC")], "pair_id long, seq_a string, seq_b string")
    with pytest.raises(ValueError, match="needs precision='float32'"):
        PairBatch(pairs, PARAMS, grad_mode="soft", soft_precision="float32")
    floats = PairBatchFloat32(pairs, PARAMS, grad_mode="soft", soft_precision="float32")
    doubles = PairBatch(pairs, PARAMS, grad_mode="soft")
    assert floats.soft_precision == "float32" and doubles.soft_precision == "double"
    assert floats.score_and_grad() == pytest.approx(doubles.score_and_grad(), rel=1e-6)
    assert floats.compute_grad().flat() == pytest.approx(doubles.compute_grad().flat(), abs=1e-3)
