import itertools
import random

import brute
import numpy as np
import pytest

from alignspark import AlignParams, SubstMatrix
from alignspark.matrices import BLOSUM62_20
from alignspark.operators.align import Problem, solve
from alignspark.plans import kernel as kn

CASES = list(itertools.product(kn.MODES, kn.MODELS))


def random_params(rng, n=3, k=1, integral=False):
    if integral:
        m, g = rng.integers(-3, 4, (k, n, n)), rng.integers(1, 4, (k, 4))
    else:
        m, g = rng.normal(0, 1.5, (k, n, n)), rng.uniform(0.3, 2, (k, 4))
    return AlignParams.from_arrays(m.astype(float), g.astype(float), "ABC"[:n])


def run(params, a, b, paths=True, tracks=None, gap_tracks=None, guides=None, **problem):
    as_codes = lambda xs: [np.array(x, np.uint8) for x in xs]
    return solve(list(range(len(a))), as_codes(a), as_codes(b), params, Problem(**problem), guides, tracks, gap_tracks, paths)


def sequences(seed, count=40, longest=4):
    rng = random.Random(seed)
    return [([rng.randrange(3) for _ in range(rng.randint(0, longest))], [rng.randrange(3) for _ in range(rng.randint(0, longest))]) for _ in range(count)]


@pytest.mark.parametrize("mode,model", CASES)
@pytest.mark.parametrize("k", [1, 3])
def test_all_paths(mode, model, k):
    rng = np.random.default_rng(k)
    params = random_params(rng, k=k)
    data = sequences(k)
    a, b = [x for x, _ in data], [y for _, y in data]
    tracks = None if k == 1 else [rng.integers(0, k, len(x)).tolist() for x in a]
    gaps = None if k == 1 else [None if i % 2 else rng.integers(0, k, len(x) + 1).tolist() for i, x in enumerate(a)]
    more = {"mode": mode, "gap_model": model, "tracks": tracks, "gap_tracks": gaps}
    hard, soft, none = (run(params, a, b, grad=g, **more) for g in ("hard", "soft", "none"))
    for i, (x, y) in enumerate(data):
        best, ways, log_z, mean = brute.ensemble(x, y, params.flat(), 3, mode, model, tracks and tracks[i], gaps and gaps[i])
        assert hard[i]["score"] == pytest.approx(best, abs=1e-9) and none[i]["score"] == hard[i]["score"]
        found = {int(f): v for f, v in zip(*hard[i]["grad"], strict=True)}
        # a local alignment without a positive cell is the empty one
        assert found in [{f: v for f, v in w.items() if v} for w in ways] or (mode == "local" and best <= 1e-9 and not found)
        assert sum(params.flat()[f] * v for f, v in found.items()) == pytest.approx(best, abs=1e-9)
        assert soft[i]["score"] == pytest.approx(log_z, abs=1e-9)
        got = dict(zip(soft[i]["grad"][0].tolist(), soft[i]["grad"][1].tolist(), strict=True))
        for f in set(got) | set(mean):
            assert got.get(f, 0) == pytest.approx(mean.get(f, 0), abs=1e-9), (f, x, y)


@pytest.mark.parametrize("mode,model", CASES)
def test_checkpoints_change_nothing(monkeypatch, mode, model):
    rng = np.random.default_rng(5)
    params = random_params(rng)
    a = [rng.integers(0, 3, n) for n in (0, 1, 17, 40, 41)]
    b = [rng.integers(0, 3, n) for n in (3, 0, 25, 38, 60)]
    kept = [run(params, a, b, mode=mode, gap_model=model, grad=g) for g in ("hard", "soft")]
    monkeypatch.setattr(kn, "TABLE_BYTES", 100)
    again = [run(params, a, b, mode=mode, gap_model=model, grad=g) for g in ("hard", "soft")]
    for x, y in zip(kept[0] + kept[1], again[0] + again[1], strict=True):
        assert x["score"] == y["score"] and x["guide"].tolist() == y["guide"].tolist()
        assert np.allclose(x["grad"][1], y["grad"][1], atol=1e-12) and x["grad"][0].tolist() == y["grad"][0].tolist()


@pytest.mark.parametrize("mode,model", CASES)
def test_bands(mode, model):
    rng = np.random.default_rng(9)
    params = random_params(rng, integral=True)
    a, b = [rng.integers(0, 3, n) for n in rng.integers(0, 20, 30)], [rng.integers(0, 3, n) for n in rng.integers(0, 20, 30)]
    more = {"mode": mode, "gap_model": model}
    full = run(params, a, b, **more)
    wide = run(params, a, b, band=25, **more)
    guided = run(params, a, b, band=3, guides=[r["guide"] for r in full], **more)
    tight = run(params, a, b, band=1, **more)
    for f, w, g, t in zip(full, wide, guided, tight, strict=True):
        assert f["score"] == w["score"] and f["guide"].tolist() == w["guide"].tolist()
        if all(o != 2 or n <= 3 for o, n in zip(*f["ops"], strict=True)):  # the path lies within its own band
            assert g["score"] == f["score"]
        assert g["score"] <= f["score"]
        assert t["score"] <= f["score"]


@pytest.mark.parametrize("mode,model", CASES)
def test_logarithms_equal_probabilities(monkeypatch, mode, model):
    rng = np.random.default_rng(8)
    params = random_params(rng, k=2)
    a, b = [rng.integers(0, 3, n) for n in rng.integers(0, 25, 20)], [rng.integers(0, 3, n) for n in rng.integers(0, 25, 20)]
    tracks = [rng.integers(0, 2, len(x)) for x in a]
    more = {"mode": mode, "gap_model": model, "grad": "soft", "tracks": tracks, "band": 9}
    fast = run(params, a, b, **more)
    monkeypatch.setattr(kn, "SAFE_EXPONENT", 0.0)
    for x, y in zip(fast, run(params, a, b, **more), strict=True):
        if np.isfinite(y["score"]):
            assert x["score"] == pytest.approx(y["score"], abs=1e-11)
            got, want = (dict(zip(r["grad"][0].tolist(), r["grad"][1].tolist(), strict=True)) for r in (x, y))
            assert all(got.get(f, 0) == pytest.approx(want.get(f, 0), abs=1e-10) for f in set(got) | set(want))


def test_long_ensembles_stay_finite():
    rng = np.random.default_rng(8)
    params = random_params(rng)
    a = [rng.integers(0, 3, 700)]
    r = run(params * 3.0, a, a, grad="soft", paths=False)[0]
    assert np.isfinite(r["score"]) and np.isfinite(r["grad"][1]).all()


def test_known_results():
    dna = AlignParams(SubstMatrix(2 * np.eye(4) - 1, "ACGT"), 2, 1, 2, 1)
    one = lambda a, b, p, **k: solve([0], [p.alphabet.codes(a)], [p.alphabet.codes(b)], p, Problem(**k))[0]
    ops = lambda r: [(int(o), int(n)) for o, n in zip(*r["ops"], strict=True)]
    assert ops(one("ACGTTTACGT", "ACGTACGT", dna)) == [(0, 3), (1, 2), (0, 5)]
    assert ops(one("ACGTACGT", "ACGTTTACGT", dna)) == [(0, 3), (2, 2), (0, 5)]
    local = one("TTTTGATTACAGGGG", "CCGATTACACC", AlignParams(SubstMatrix(2 * np.eye(4) - 1, "ACGT"), 4, 2, 4, 2), mode="local")
    assert ops(local) == [(0, 7)] and local["start"] == (4, 2) and local["score"] == 7
    protein = AlignParams(BLOSUM62_20, 11, 1, 11, 1)
    assert one("PLEASANTLY", "MEANLY", protein)["score"] == -3
    tiny = AlignParams(SubstMatrix([[2.0]], "A"), 2, 1, 1.5, 0.5)
    z = np.exp(one("A", "A", tiny, mode="local", grad="soft")["score"])
    assert z == pytest.approx(4 + np.exp(2) + np.exp(-3) + np.exp(-2))
    empty = one("", "AAA", tiny, mode="local", grad="soft")
    assert empty["score"] == pytest.approx(np.log(4)) and not empty["grad"][1].any()


def test_equal_sets_are_one_set():
    rng = np.random.default_rng(2)
    one = random_params(rng)
    three = AlignParams.stack([one, one, one])
    a, b = [rng.integers(0, 3, n) for n in rng.integers(0, 30, 20)], [rng.integers(0, 3, n) for n in rng.integers(0, 30, 20)]
    tracks = [rng.integers(0, 3, len(x)) for x in a]
    for mode, model in CASES:
        for x, y in zip(run(one, a, b, mode=mode, gap_model=model), run(three, a, b, tracks=tracks, mode=mode, gap_model=model), strict=True):
            assert x["score"] == y["score"] and x["guide"].tolist() == y["guide"].tolist()


def test_gradient_is_the_slope():
    rng = np.random.default_rng(3)
    params = random_params(rng)
    a, b = [rng.integers(0, 3, 6)], [rng.integers(0, 3, 7)]
    for (mode, model), t in itertools.product(CASES, (1.0, 0.5)):
        base = run(params, a, b, mode=mode, gap_model=model, grad="soft", temperature=t)[0]
        grad = np.zeros(params.n_fields)
        grad[base["grad"][0]] = base["grad"][1]
        for f in range(params.n_fields):
            up, down = params.flat(), params.flat()
            up[f] += 1e-5
            down[f] -= 1e-5
            hi, lo = (run(params.like_flat(x), a, b, mode=mode, gap_model=model, grad="soft", temperature=t)[0]["score"] for x in (up, down))
            assert (hi - lo) / 2e-5 == pytest.approx(grad[f], abs=1e-6)


def test_number_types():
    rng = np.random.default_rng(4)
    params = random_params(rng, integral=True)
    a, b = [rng.integers(0, 3, 12)], [rng.integers(0, 3, 9)]
    want = run(params, a, b)[0]["score"]
    for kind in ("float32", "int8", "int16", "int32", "int64"):
        assert run(params, a, b, precision=kind)[0]["score"] == want
    with pytest.raises(OverflowError):
        run(params * 30, [rng.integers(0, 3, 400)], b, precision="int16")
    with pytest.raises(ValueError, match="integral"):
        Problem(precision="int16").check(params * 0.5)
    with pytest.raises(ValueError, match="soft"):
        Problem(precision="int32", grad="soft")
    with pytest.raises(ValueError, match="temperature"):
        Problem(temperature=0.0)
    with pytest.raises(ValueError, match="unknown mode"):
        Problem(mode="best")


def test_posterior_guides_are_monotone():
    rng = np.random.default_rng(6)
    params = random_params(rng)
    a = [rng.integers(0, 3, n) for n in (5, 9, 0, 14)]
    for mode, model in CASES:
        for x, r in zip(a, run(params, a, a, mode=mode, gap_model=model, grad="soft", posterior=True), strict=True):
            g = r["guide"]
            assert len(g) == len(x) + 1 and (np.diff(g) >= 0).all() and g.min() >= 0 and g.max() <= len(x)
    sharp = AlignParams(SubstMatrix(20 * np.eye(3) - 10, "ABC"), 20, 10, 20, 10)
    assert run(sharp, a, a, grad="soft", posterior=True)[3]["guide"].tolist() == list(range(15))
