"""Work and plans of queries whose pairs outgrow their tables."""

from dataclasses import replace

import duckdb
import numpy as np
import pytest

from alignspark import AlignParams, SubstMatrix, catalog
from alignspark.alphabet import DNA
from alignspark.operators import align, tiles
from alignspark.operators.align import Problem
from alignspark.plans import crossed as cross
from alignspark.plans import kernel

UNIT = AlignParams(SubstMatrix(np.eye(4) - 1, "ACGT"), 0, 1, 0, 1)


def test_journeys_are_paired_without_a_shuffle_of_pairs(spark, tmp_path):
    """Users of equal journeys are aligned as a class, and no pair of users is dealt out."""
    rows = [(u, t, 1000 * u + t, kind) for u in range(300) for t, kind in enumerate(["view", "click", ("error", "signup", "purchase")[u % 3]])]
    spark.createDataFrame(rows, "user_id long, ts long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    aligned = catalog.journeys(spark, str(tmp_path))
    assert aligned.count() < 1000
    found = catalog.QUERIES["journey_scores"](spark, str(tmp_path))
    scores = {tuple(map(int, r.pair_id.split(":"))): r.score for r in found.collect()}
    assert len(scores) == 300 * 299 // 2 and all(x < y and s == (6 if x % 3 == y % 3 else 4) for (x, y), s in scores.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "Aggregate" not in plan


def test_edit_paths_by_bits_equal_the_kernel(monkeypatch):
    """Distances and moves of pairs whose table is filled a bit a cell, and of tiles of one; a pair of 8,000 letters in a second or so."""
    rng, problem = np.random.default_rng(4), Problem("global", "linear", "none")
    pairs = [tuple(rng.integers(0, k, rng.integers(0, 40)).astype(np.uint8) for _ in range(2)) for k in (2, 3, 4) for _ in range(60)]
    a, b = zip(*pairs, strict=True)
    want = align.solve(range(len(a)), list(a), list(b), UNIT, problem)
    monkeypatch.setattr(align, "EDIT_CELLS", 0)
    got = align.solve(range(len(a)), list(a), list(b), UNIT, problem)
    for x, y in zip(want, got, strict=True):
        assert x["score"] == y["score"] and all((u == v).all() for u, v in zip(x["ops"], y["ops"], strict=True)) and (x["guide"] == y["guide"]).all()
    monkeypatch.setattr(kernel, "viterbi", None)
    long = [rng.integers(0, 4, 8000).astype(np.uint8) for _ in range(2)]
    found = align.solve([0], [long[0]], [long[1]], UNIT, problem)[0]
    assert found["end"] == (8000, 8000) and sum(found["ops"][1][found["ops"][0] != 1]) == 8000


def test_tiles_of_edit_distances(spark):
    """As many waves for long pairs as for short ones, and the paths of the kernel."""
    rng = np.random.default_rng(8)
    text = lambda n: "".join(np.array(list("ACGT"))[rng.integers(0, 4, n)])
    pairs = spark.createDataFrame([(1, text(70), text(50)), (2, text(9), text(64)), (3, "", text(5)), (4, text(5), ""), (5, "", "")], "pair_id long, seq_a string, seq_b string")
    problem, names = Problem("global", "linear", "none"), ["pair_id", "score", "ops", "start_i", "start_j", "end_i", "end_j"]
    want = sorted(map(tuple, align.align(pairs, UNIT, problem, ("score", "path")).select(names).collect()))
    assert sorted(map(tuple, tiles.align_tiled(pairs, UNIT, problem, ("score", "path"), 13).select(names).collect())) == want
    waves, filled = [], tiles._filled
    tiles._filled = lambda *x: waves.append(1) or filled(*x)
    try:
        long = spark.createDataFrame([(1, text(3000), text(3000))], "pair_id long, seq_a string, seq_b string")
        assert tiles.align_tiled(long, UNIT, problem, tile=20).first().score < 0
    finally:
        tiles._filled = filled
    assert len(waves) <= 2 * tiles.SIDE


@pytest.mark.parametrize("mode", ["global", "local", "glocal"])
def test_crossed_lists_equal_the_kernel(monkeypatch, mode):
    """Scores of whole cross products in 8 and more bits, lists longer than a block, are the kernel's."""
    rng = np.random.default_rng(5)
    for model, match, mismatch, *gaps in (("affine", *catalog.AFFINE), ("affine", *catalog.SKEWED), ("linear", *catalog.PLAIN), ("affine", 200, -300, 50, 100, 70, 10)):
        params, problem = catalog.uniform(DNA, match, mismatch, *gaps), Problem(mode, model, "none")
        for m, n in ((0, 0), (0, 3), (4, 0), (5, 9), (32, 32), (40, 7)):
            a, b = (rng.integers(0, 4, (k, width)).astype(np.uint8) for k, width in ((7, m), (11, n)))
            want = align.solve_arrays(range(77), [x for x in a for _ in b], [y for _ in a for y in b], params, problem, paths=False)["score"].reshape(7, 11)
            for most in (100, 1 << 19):
                monkeypatch.setattr(cross, "BYTES", most)
                assert (cross.Crossed(problem.scoring(params), m, n).scores(a, b) == want).all()
    with pytest.raises(ValueError):
        cross.Crossed(problem.scoring(catalog.uniform(DNA, 1, 0.5, 1, 1, 1, 1)), 3, 3)


@pytest.mark.parametrize("name", ["batch_total", "score_histogram", "logistic_step"])
def test_pairs_that_are_counted_have_no_row(spark, tmp_path, monkeypatch, name):
    """Tables with missing nations and segments, and supplier keys that carry: as in SQL, with rows far fewer than pairs."""
    nation = lambda k: None if k % 50 == 7 else k % 2
    customers = [(k, nation(k), None if k % 3 == 0 else f"S{k % 3}") for k in range(1, 301)]
    suppliers = [(k, nation(k)) for k in range(1, 100)] + [(1_000_000 + k, 5) for k in range(4)]
    spark.createDataFrame([*customers, (400, 5, "S8"), (401, 3, "S9")], "c_custkey long, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(catalog, "align", None)
    blocks, counted = [], catalog.score_counts
    monkeypatch.setattr(catalog, "score_counts", lambda x, *rest: blocks.append(x) or counted(x, *rest))
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert blocks[0].count() < 100
    con = duckdb.connect()
    for table in ("customer", "supplier"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.execute(catalog.ORACLE_SQL[name]).fetchall()))


@pytest.mark.parametrize("mode", ["global", "local", "glocal"])
def test_gradients_by_score_equal_the_kernel(monkeypatch, mode):
    """Gradients of the best paths of whole cross products, summed by score, are sums of the kernel's."""
    rng = np.random.default_rng(6)
    for model, match, mismatch, *gaps in (("affine", *catalog.AFFINE), ("affine", *catalog.SKEWED), ("linear", *catalog.PLAIN), ("affine", 5, -3, 2, 1, 0, 0)):
        params, problem = catalog.uniform(DNA, match, mismatch, *gaps), Problem(mode, model, "hard")
        for m, n in ((0, 0), (0, 3), (4, 0), (5, 9), (32, 32), (40, 7)):
            a, b = (rng.integers(0, 4, (k, width)).astype(np.uint8) for k, width in ((7, m), (11, n)))
            found = align.solve_arrays(range(77), [x for x in a for _ in b], [y for _ in a for y in b], params, problem, paths=False)
            edges, field, value = found["grad"]
            scores, of_pair = np.unique(found["score"], return_inverse=True)
            want = np.zeros((len(scores), params.n_fields))
            np.add.at(want, (np.repeat(of_pair, np.diff(edges)), field), value)
            for most in (1000, 1 << 20):
                monkeypatch.setattr(cross, "PATH_BYTES", most)
                got = cross.Crossed(problem.scoring(params), m, n).path_sums(a, b)
                assert (got[0] == scores).all() and (got[1] == np.bincount(of_pair)).all() and (got[2] == want).all()


def test_the_bound_of_gradients_without_them(spark, sf, monkeypatch):
    """Ways and refusals are those of a pass that forms gradients; the query forms none, nor sums in logarithms backwards."""
    rng = np.random.default_rng(7)
    params, problem = catalog.uniform(DNA, *catalog.STEEP), Problem("glocal", "linear", "soft")
    heads = [rng.integers(2, 4, 32).astype(np.uint8) for _ in range(20)]
    a = [x if k % 2 else np.concatenate([x, x % 2]) for k, x in enumerate(heads)]
    b = [np.concatenate([1 - x % 2, x]) for x in heads]
    for impl in ("scaled_or_log", "scaled", "log"):
        p = replace(problem, soft_impl=impl)
        want = align.solve_arrays(range(20), a, b, params, p, paths=False)
        got = align.solve_arrays(range(20), a, b, params, p, paths=False, gradient=False, bounded=True)
        assert (want["way"] == got["way"]).all() and want["refused"] == got["refused"] and "grad" not in got
        assert all(x == y for k, (x, y) in enumerate(zip(want["score"], got["score"], strict=True)) if k not in want["refused"])
    asked, aligned = [], catalog.align
    monkeypatch.setattr(catalog, "align", lambda *x, **y: asked.append(aligned(*x, **y)) or asked[-1])
    assert "way" in catalog.QUERIES["soft_lost_mass"](spark, sf).columns
    assert len(asked) == 2 and not any("grad" in df.columns for df in asked)


@pytest.mark.parametrize("weights", [("affine", *catalog.AFFINE), ("affine", 5, -3, 7, 2, 1, 2), ("linear", *catalog.PLAIN), ("affine", 200, -300, 50, 160, 70, 160), ("affine", 2, -2, 0, 1, 0, 1), ("affine", 1, 0, 0, 0, 0, 0)])
def test_rows_equal_diagonals(monkeypatch, weights):
    """Local scores of long lists, filled row by row, are those of diagonals: equal sequences, long gaps and gaps near the ends, too."""
    rng = np.random.default_rng(8)
    model, *costs = weights
    monkeypatch.setattr(cross, "LONG", 50)
    monkeypatch.setattr(cross, "WIDE", 40)
    used, by_rows = [], cross.Crossed._by_rows
    for m, n, left, right in ((32, 32, 20, 90), (32, 32, 90, 20), (20, 9, 60, 70), (3, 50, 20, 90), (1, 1, 5, 60)):
        a, b = rng.integers(0, 4, (left, m)).astype(np.uint8), rng.integers(0, 4, (right, n)).astype(np.uint8)
        a[5 % left] = a[0]
        for k in range(min(left, right) - 2 if m == 32 else 0):  # letters put in or left out after some
            at, gap = 4 + k % 9, 1 + k % 13
            b[k] = np.concatenate([a[k][:at], rng.integers(0, 4, gap), a[k][at:]])[:n] if k % 2 else np.concatenate([a[k][:at], a[k][at + gap :], a[k][:gap]])
        s = cross.Crossed(Problem("local", model, "none").scoring(catalog.uniform(DNA, *costs)), m, n)
        monkeypatch.setattr(cross.Crossed, "_by_rows", lambda *x: used.append(by_rows(*x)) or used[-1])
        found = s.scores(a, b)
        monkeypatch.setattr(cross.Crossed, "_by_rows", lambda *x: False)
        assert (found == s.scores(a, b)).all()
    assert any(used)


def test_named_pairs_do_not_repeat_sequences(spark, monkeypatch):
    """Names by id and offset, over spans, with ids that have no, two and null names: as counted one by one, each sequence in one chunk."""
    from alignspark.operators import crossed

    monkeypatch.setattr(crossed, "SPAN", 16)
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("ACGT"), n))
    left = [(None if k == 4 else k % 2, None if k == 9 else k, word(6 + k % 2)) for k in range(-5, 40)]
    right = [(k % 3, None if k == 8 else (0, 3, 16, 37, -2)[k % 5], word(7)) for k in range(30)]
    names = [(k, None if k % 5 == 0 else f"n{k % 3}") for k in range(60) if k % 7] + [(10, "twice"), (None, "none")]
    a, b = (spark.createDataFrame(rows, f"k int, {i} long, s string") for rows, i in ((left, "id"), (right, "by")))
    blocks = crossed.crossed_named(a, b.withColumnRenamed("s", "t"), ["k"], "id", "s", "t", "by", spark.createDataFrame(names, "id long, name string"), "id", "name")
    params, problem = catalog.uniform(DNA, *catalog.AFFINE), Problem("local", "affine", "none")
    want: dict[tuple, int] = {}
    for k, i, s in left:
        for q, by, t in right:
            if k is not None and k == q and i is not None and by is not None:
                score = align.solve_arrays([0], *([np.array(["ACGT".index(c) for c in x], np.uint8)] for x in (s, t)), params, problem, paths=False)["score"][0]
                for j, name in names:
                    if j == i + by:
                        want[name, float(score)] = want.get((name, float(score)), 0) + 1
    found = crossed.score_counts(blocks, params, problem, (), "name")
    assert {(r[0], r.score): r.n for r in found.collect()} == want
    # Offsets of one span (here three: below 0, 0 to 15 and from 16 on twice) share a chunk, so no id is repeated for each of them.
    assert blocks.selectExpr("sum(size(seqs_a))").first()[0] <= 4 * len(left)


def test_supplier_keys_that_carry_repeat_no_customer(spark, tmp_path, monkeypatch):
    # Customers of the suppliers' nation are so far apart that no two pairs have one number.
    spark.range(1, 201).selectExpr("id c_custkey", "if(id % 60 = 0, 1, 2) c_nationkey", "'S' || id % 3 c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(50).selectExpr("id * 1000000 + 7 s_suppkey", "1 s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    blocks, counted = [], catalog.score_counts
    monkeypatch.setattr(catalog, "score_counts", lambda x, *rest: blocks.append(x) or counted(x, *rest))
    found = catalog.QUERIES["score_histogram"](spark, str(tmp_path))
    assert blocks[0].selectExpr("sum(size(seqs_a))").first()[0] == 3
    con = duckdb.connect()
    for table in ("customer", "supplier"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.execute(catalog.ORACLE_SQL["score_histogram"]).fetchall()))


@pytest.mark.parametrize("mode", ["global", "local", "glocal"])
def test_bands_and_dots_of_crossed_lists_equal_the_kernel(monkeypatch, mode):
    """Scores within a band of the main diagonal, and gradients of best paths times the parameters, are the kernel's."""
    rng = np.random.default_rng(10)
    for model, match, mismatch, *gaps in (("affine", *catalog.AFFINE), ("affine", *catalog.SKEWED), ("linear", *catalog.PLAIN), ("affine", 200, -300, 50, 100, 70, 10)):
        params = catalog.uniform(DNA, match, mismatch, *gaps)
        for m, n in ((0, 3), (4, 0), (1, 20), (9, 30), (32, 32), (40, 7)):
            a, b = (rng.integers(0, 4, (k, width)).astype(np.uint8) for k, width in ((7, m), (11, n)))
            for band in (0, 1, 4, 64):
                problem = Problem(mode, model, "none", band=band)
                want = align.solve_arrays(range(77), [x for x in a for _ in b], [y for _ in a for y in b], params, problem, paths=False)["score"].reshape(7, 11)
                s = cross.Crossed(problem.scoring(params), m, n, band)
                assert (s.scores(a, b) == want).all()
                if not band:
                    monkeypatch.setattr(cross, "PATH_BYTES", 20000)
                    assert (s.path_dots(a, b, params.flat()) == want).all()


def test_the_best_of_a_block_are_kept():
    """Of every number's pairs the k best, ties included; numbers that are no multiples are all kept."""
    from alignspark.operators.crossed import _near_best

    rng = np.random.default_rng(11)
    scores, left, right = rng.integers(0, 9, (5, 40)), 100 * np.arange(5), rng.integers(0, 300, 40)
    keep, ids = _near_best(scores, left, right, 3, 100), left[:, None] + right
    for row in range(5):
        for q in set(ids[row] // 100):
            of = ids[row] // 100 == q
            assert (keep[row][of] == (scores[row][of] >= sorted(scores[row][of])[-min(3, of.sum())])).all()
    assert _near_best(scores, left + 1, right, 3, 100).all()


CROSSED = ["nw_score_affine", "nw_score_asymmetric", "nw_score_banded", "sw_score_affine", "glocal_score_affine", "best_hit_topk", "band_wide_equals_full", "hard_grad_dot_params", "compute_grad_total", "grad_in_order", "weighted_grad", "batch_banded_step"]


@pytest.mark.parametrize("name", CROSSED)
def test_pairs_have_a_row_from_their_score_on(spark, tmp_path, monkeypatch, name):
    """As in SQL, from blocks far fewer than pairs; no pair is a row before it has a score, or is joined after."""
    customers = [(k, None if k % 50 == 7 else k % 2) for k in range(1, 61)]
    suppliers = [(k, None if k % 50 == 7 else k % 2) for k in range(1, 40)] + [(1_000_000 + k, 5) for k in range(4)]
    spark.createDataFrame([*customers, (400, 5), (401, 3)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    made = []
    for f in ("align", "align_summed"):
        monkeypatch.setattr(catalog, f, None)
    for f in ("crossed", "crossed_numbered"):
        monkeypatch.setattr(catalog, f, lambda *x, make=getattr(catalog, f): made.append(make(*x)) or made[-1])
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert made[0].count() < 20
    con = duckdb.connect()
    for table in ("customer", "supplier"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.execute(catalog.ORACLE_SQL[name]).fetchall()))


def test_pending_pairs_are_not_shuffled(spark, sf):
    """What is done is left out before pairs are made: a nation's customers, once."""
    plan = catalog.QUERIES["pairs_pending_antijoin"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    anti, pairs = plan.index("Join LeftAnti"), plan.index("Join Inner")
    assert pairs < anti and plan.count("Join") == 2  # the tree's leaves come last


def test_guides_of_crossed_lists_equal_the_kernel(monkeypatch):
    """Guides of best local paths, and local scores around them under other parameters."""
    rng = np.random.default_rng(12)
    for model, old, new in (("affine", catalog.AFFINE, catalog.SKEWED), ("linear", catalog.PLAIN, (3, -2, 0, 2, 0, 1)), ("affine", (200, -300, 50, 100, 70, 10), catalog.AFFINE)):
        before, after, problem = catalog.uniform(DNA, *old), catalog.uniform(DNA, *new), Problem("local", model, "none")
        for m, n in ((0, 3), (4, 0), (1, 1), (9, 30), (32, 32), (40, 7)):
            a, b = (rng.integers(0, 4, (k, width)).astype(np.uint8) for k, width in ((7, m), (11, n)))
            left, right = [x for x in a for _ in b], [y for _ in a for y in b]
            edges, flat = align.solve_arrays(range(77), left, right, before, problem)["guide"]
            monkeypatch.setattr(cross, "PATH_BYTES", 100_000)
            guides = cross.Crossed(problem.scoring(before), m, n).guides(a, b)
            assert (guides.reshape(m + 1, 77).T.ravel() == flat).all()
            for band in (1, 4, 64):
                p = replace(problem, band=band)
                want = align.solve_arrays(range(77), left, right, after, p, guides=[flat[x:y] for x, y in zip(edges, edges[1:])], paths=False)["score"]
                assert (cross.Crossed(p.scoring(after), m, n, band).scores_around(a, b, guides).ravel() == want).all()


def test_shared_words_are_counted_where_chunks_meet(spark, sf, monkeypatch):
    """As counted pair by pair, with many letters and few, a few hits at a time; no shared word or pair is a row to be grouped."""
    from alignspark.operators import pairs

    rng = np.random.default_rng(13)
    monkeypatch.setattr(pairs, "HITS", 50)
    for letters, k in (("ACGT", 3), ("ab", 2), ("".join(map(chr, range(200, 900))) + "\U0001f600", 8)):
        base = "".join(rng.choice(list(letters), 30))
        texts = [[base[x : x + 12] + "".join(rng.choice(list(letters), rng.integers(0, 9))) for x in rng.integers(0, 18, n)] for n in (25, 40)]
        words = [[{s[x : x + k] for x in range(len(s) - k + 1)} for s in side] for side in texts]
        for least in (1, 3):
            want = {(x, y): len(a & b) for x, a in enumerate(words[0]) for y, b in enumerate(words[1]) if len(a & b) >= least}
            found = [(int(x), int(y), int(n)) for part in pairs._shared_words(*map(pairs.pa.array, texts), k, least) for x, y, n in zip(*part, strict=True)]
            assert len(found) == len(want) and {x[:2]: x[2] for x in found} == want
    plan = catalog.QUERIES["pairs_seed_join"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and "Generate explode(" in plan
