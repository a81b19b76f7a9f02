import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignspark import DNA, AlignParams, SubstMatrix
from alignspark.functions import encoding, render
from alignspark.functions.oneoff import guide_j_from_aligned
from alignspark.operators import gradient, logistic
from alignspark.operators.align import Problem, align, dealt, score_distinct
from alignspark.operators.batch import PairBatch, SeqPair
from alignspark.operators.pairs import block_pairs, seed_pairs
from alignspark.sources import readers
from alignspark.streaming.scoring import score_stream, windowed_scores

PARAMS = AlignParams(SubstMatrix(6 * np.eye(4) - 4, "ACGT"), 4, 2, 5, 1)


def pairs_of(spark, n=60, longest=30, seed=1):
    rng = random.Random(seed)
    seq = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(0, longest)))
    return readers.zip_pairs(spark, [seq() for _ in range(n)], [seq() for _ in range(n)]).repartition(3)


@pytest.mark.parametrize("mode", ["global", "local", "glocal"])
def test_views_agree_with_each_other(spark, mode):
    rows = align(pairs_of(spark), PARAMS, Problem(mode), ("score", "path", "guide", "grad")).join(pairs_of(spark), "pair_id")
    view = [F.col(c) for c in ("seq_a", "seq_b", "ops", "start_i", "start_j")]
    rows = rows.withColumn("al", render.aligned(*view)).select(
        "*", render.cigar(*view).alias("m"), render.cigar(*view, extended=True, soft_clip=True).alias("x"), render.coordinates(*view[2:]).alias("xy"),
        render.index_pairs(*view[2:]).alias("ij"), render.formatted(F.col("al"), 7).alias("text"), render.guide_from_aligned(F.col("al.a"), F.col("al.b")).alias("g"),
        render.valid_guide(F.col("guide_j"), F.length("seq_a"), F.length("seq_b")).alias("valid"),
    )
    for r in rows.collect():
        a, b = r.al
        assert a.replace("-", "") == r.seq_a[r.start_i : r.end_i] and b.replace("-", "") == r.seq_b[r.start_j : r.end_j]
        assert r.xy.a[0] == r.start_i and r.xy.b[-1] == r.end_j and len(r.xy.a) == max(len(r.ops), 1) + 1
        marks = "".join("D" if x == "-" else "I" if y == "-" else "=" if x == y else "X" for x, y in zip(a, b, strict=True))
        marks = "S" * r.start_i + marks + "S" * (len(r.seq_a) - r.end_i)
        runs = []
        for ch in marks:
            if runs and runs[-1][0] == ch:
                runs[-1][1] += 1
            else:
                runs.append([ch, 1])
        assert r.x == "".join(f"{n}{c}" for c, n in runs)
        assert r.m == "".join(f"{x.len}{'MID'[x.op]}" for x in r.ops)
        assert [(p.i, p.j) for p in r.ij] == [(r.start_i + len(a[:k].replace("-", "")), r.start_j + len(b[:k].replace("-", ""))) for k in range(len(a)) if a[k] != "-" != b[k]]
        lines = r.text.split("\n")
        assert "".join(lines[::4]) == a and "".join(lines[2::4]) == b
        assert list(r.g) == guide_j_from_aligned(a, b) and r.valid
        assert sum(PARAMS.flat()[f] * v for f, v in r.grad.items()) == r.score


def test_batch_lifecycle(spark):
    pairs = pairs_of(spark)
    batch = PairBatch(pairs, PARAMS, mode="local")
    for early in (batch.scores, batch.compute_grad, batch.guides, batch.aligned):
        with pytest.raises(RuntimeError):
            early()
    with pytest.raises(RuntimeError):
        batch.banded_grad(3)
    total = batch.score_and_grad(keep_paths=True)
    assert total == batch.compute_grad().dot(PARAMS) == batch.compute_grad(in_order=True).dot(PARAMS)
    assert batch.cigars().count() == batch.formatted().count() == len(batch) == 60
    assert batch.weighted_grad([2.0] * 60).dot(PARAMS) == 2 * total
    dense = batch.grads().first()
    assert len(dense.matrix_grad) == 16 and len(dense.gap_grad) == 4
    batch.drop_paths()
    with pytest.raises(RuntimeError):
        batch.aligned()
    assert batch.scores().count() == 60
    batch.set_params(PARAMS * 2.0)
    with pytest.raises(RuntimeError):
        batch.scores()
    assert batch.banded_grad(30) == 2 * total
    streamed = batch.align(pairs, PARAMS)
    assert streamed.total == total and streamed.grad.dot(PARAMS) == total
    assert batch[3].first().pair_id == 3
    for wrong, error in ((lambda: batch.banded_grad(0), ValueError), (lambda: batch.weighted_grad([1.0]), ValueError), (lambda: batch.set_params(AlignParams(np.eye(20))), ValueError), (lambda: batch[99], IndexError), (lambda: PairBatch(pairs, PARAMS, hb_cutoff=0), ValueError), (lambda: PairBatch(pairs, PARAMS, traceback="x"), ValueError), (lambda: PairBatch(None, PARAMS).score_and_grad(), RuntimeError)):
        with pytest.raises(error):
            wrong()


def test_single_pair(spark):
    p = SeqPair(spark, "TTTTGATTACAGGGG", "CCGATTACACC", AlignParams(SubstMatrix(2 * np.eye(4) - 1, "ACGT"), 4, 2, 4, 2), mode="local")
    assert not p.score_valid and not p.path_valid
    for read in (lambda: p.score, lambda: p.grad, lambda: p.guide_j, p.aligned):
        with pytest.raises(RuntimeError):
            read()
    assert p.align() == 7 == p.score and p.cigar() == "7M" and p.cigar(soft_clip=True) == "4S7M4S" and p.coordinates() == ([4, 11], [2, 9])
    assert p.formatted(0) == "GATTACA\n|||||||\nGATTACA" and p.aligned() == ("GATTACA", "GATTACA")
    assert p.grad.matrix.score("A", "A") == 3 and p.guide_j[4] == 2
    p.drop_paths()
    assert p.score_valid and p.grad_valid and not p.stored_path_valid
    with pytest.raises(ValueError):
        SeqPair(spark, "AN", "A", PARAMS)
    with pytest.raises(RuntimeError):
        SeqPair(spark, "A", "A", PARAMS, grad_mode="none").score_and_grad()


def test_soft_sums_and_temperature(spark):
    pairs = pairs_of(spark, 20, 12)
    batch = PairBatch(pairs, PARAMS, grad_mode="soft", soft_temperature=2.0)
    total = batch.score_and_grad()
    hot = align(pairs, PARAMS * 0.5, Problem(grad="soft")).agg(F.sum("score")).first()[0] * 2
    assert total == pytest.approx(hot, rel=1e-12)
    a, b = batch.compute_grad(), batch.compute_grad(in_order=True)
    assert np.allclose(a.flat(), b.flat(), rtol=1e-12)


def test_distinct_scoring_and_spreading(spark):
    pairs = pairs_of(spark, 30, 3)
    one = {r.pair_id: r.score for r in align(pairs, PARAMS, Problem(grad="none")).collect()}
    assert {r.pair_id: r.score for r in score_distinct(pairs, PARAMS).collect()} == one
    assert dealt(pairs.coalesce(1), 5).rdd.getNumPartitions() == 5 and dealt(pairs, 5).count() == 30 and dealt(pairs, 0) is pairs


def test_errors_name_the_pair(spark):
    for seq, text in (("AN", "pair 7, seq_b: character 'N'"), (None, "pair 7: seq_b is null")):
        df = spark.createDataFrame([(7, "A", seq)], "pair_id long, seq_a string, seq_b string")
        with pytest.raises(Exception, match=text):
            align(df, PARAMS).collect()
    bad = spark.createDataFrame([(7, "AC", "AC", [0, 2, 1])], "pair_id long, seq_a string, seq_b string, guide_j array<int>")
    with pytest.raises(Exception, match="guide decreases"):
        align(bad, PARAMS).collect()
    assert align(bad.limit(0), PARAMS, outputs=("score", "path", "guide", "grad")).count() == 0


def test_logistic(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(-3, 2), float(rng.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "pair_id long, score double, label double").cache()
    for start in (0.0, 40.0, -60.0):
        alpha = logistic.fit_alpha(df, start)
        assert abs(sum(y - 1 / (1 + math.exp(-(alpha + s))) for _, s, y in rows)) < 1e-6
    far = logistic.probabilities(spark.createDataFrame([(800.0,), (-800.0,)], "score double"), 0.0).collect()
    assert [r.probability for r in far] == [1.0, 0.0]
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError):
            logistic.fit_alpha(df, bad)
    with pytest.raises(ValueError):
        logistic.fit_alpha(df.withColumn("score", F.lit(float("nan"))))
    with pytest.raises(RuntimeError):
        logistic.fit_alpha(df.withColumn("label", F.lit(1.0)), maxiter=2)
    like = df.agg(F.sum(logistic.log_likelihood(F.col("score"), F.col("label"), 0.5))).first()[0]
    assert like == pytest.approx(sum(y * (s + 0.5) - math.log1p(math.exp(s + 0.5)) for _, s, y in rows))


def test_logistic_step(spark):
    pairs = pairs_of(spark, 40, 10)
    batch = PairBatch(pairs, PARAMS, mode="local", grad_mode="hard")
    batch.score_and_grad()
    labels = pairs.select("pair_id", (F.col("pair_id") % 2).cast("double").alias("label"))
    found = logistic.step(batch, labels, -1.0)
    scores = {r.pair_id: r.score for r in batch.scores().collect()}
    want = batch.weighted_grad([i % 2 - 1 / (1 + math.exp(-(found.alpha + scores[i]))) for i in range(40)])
    assert np.allclose(found.grad.flat(), want.flat(), atol=1e-9)
    with pytest.raises(ValueError):
        logistic.step(batch, labels.limit(3))


def test_pair_joins_and_reductions(spark):
    rows = spark.createDataFrame([(1, "x", "ACGTA"), (2, "x", "CGTAC"), (3, "y", "GGGGG"), (4, "x", "AC")], "id long, g string, s string")
    assert sorted((r.id_a, r.id_b) for r in block_pairs(rows, "id", "s", "g").collect()) == [(1, 2), (1, 4), (2, 4)]
    assert [(r.id_a, r.id_b, r.shared) for r in seed_pairs(rows.where("id = 1"), rows, 3, "id", "s").collect()] == [(1, 2, 2)]


def test_a_word_that_many_sequences_hold_is_dealt_out(spark):
    rows = spark.createDataFrame([(k, "ACGTAC" + "ACGT"[k % 4] * (k % 3)) for k in range(60)] + [(60, None), (61, "AC"), (62, "")], "id long, s string")
    found = [sorted(map(tuple, seed_pairs(rows.where("id % 20 = 0 or id > 59"), rows, 6, "id", "s", salts=k).collect())) for k in (1, 8)]
    assert found[0] == found[1] and len(found[0]) == 3 * 59 and {r[:2] for r in found[0]} == {(q, k) for q in (0, 20, 40) for k in range(60) if k != q}
    plan = seed_pairs(rows.where("id = 0"), rows, 6, "id", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "_salt" in plan
    named = gradient.summed(align(pairs_of(spark), PARAMS, outputs=("score", "grad"))).select(gradient.field_names(PARAMS, F.col("field")).alias("n"))
    assert {"0.AA", "0.gap_extend_a", "0.gap_open_b"} <= {r.n for r in named.collect()}


def test_encoding(spark):
    df = spark.createDataFrame([("ACGT",), ("",), ("ACxT",), (None,)], "s string")
    got = df.select(encoding.is_valid(F.col("s"), DNA).alias("ok"), encoding.first_foreign(F.col("s"), DNA).alias("at")).collect()
    assert [r.ok for r in got] == [True, True, False, None] and [r["at"] for r in got] == [-1, -1, 2, None]
    fine = df.where("s != 'ACxT'").select(encoding.decode(encoding.encode(F.col("s"), DNA), DNA).alias("s"), encoding.encode(F.col("s"), DNA).alias("c")).collect()
    assert [r.s for r in fine] == ["ACGT", ""] and fine[0].c == [0, 1, 2, 3]
    with pytest.raises(Exception, match="position 2"):
        df.select(encoding.encode(F.col("s"), DNA)).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("ACGT\tAC\n\tG\n")
    assert [(r.seq_a, r.seq_b) for r in readers.read_pairs_tsv(spark, str(tmp_path / "p.tsv")).collect()] == [("ACGT", "AC"), ("", "G")]
    readers.write_pairs_tsv(pairs_of(spark, 9), str(tmp_path / "out"))
    assert readers.read_pairs_tsv(spark, str(tmp_path / "out")).count() == 9
    (tmp_path / "s.fa").write_text(">one first\nACG\nT\n>two\n\n>three\nGG\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "s.fa")).collect()] == [("one", "one first", "ACGT"), ("two", "two", ""), ("three", "three", "GG")]
    flat = spark.createDataFrame([(0, 1, 5), (0, 0, 4)], "pair_id long, position int, set int")
    assert readers.with_flat_tracks(pairs_of(spark, 1), flat).first().track == [4, 5]
    with pytest.raises(ValueError):
        readers.zip_pairs(spark, ["A"], [])


def test_stream(spark, tmp_path):
    pairs = pairs_of(spark, 30).withColumn("ts", F.timestamp_seconds(F.col("pair_id") * 60))
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    scored = score_stream(stream, PARAMS, Problem("local", grad="none"), keep=("ts",))
    q = windowed_scores(scored, "ts", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    want = align(pairs, PARAMS, Problem("local", grad="none")).agg(F.sum("score")).first()[0]
    got = spark.sql("select count(*) n, sum(total) t from windows").first()
    assert got.n == 3 and got.t == want


def test_pairs_in_one_partition_are_dealt_out(spark):
    pairs = pairs_of(spark, 400, 20).coalesce(1)
    plan = align(pairs, PARAMS, Problem("local", grad="none"))
    used = plan.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0]
    assert used > 4
    one = align(pairs, PARAMS, Problem("local", grad="none"), tasks=0)
    assert one.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0] == 1
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, one.collect()))


def test_errors_as_a_column(spark):
    rows = [(1, "ACGT", "ACG", None), (2, None, "A", None), (3, "A", "AN", None), (4, "AC", "AC", [0, 2, 1]), (5, "AC", "AC", [0, 1, 2])]
    df = spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string, guide_j array<int>")
    got = {r.pair_id: r for r in align(df, PARAMS, Problem(band=1), ("score", "path", "guide", "grad"), on_error="null").collect()}
    assert [got[i].error is None for i in range(1, 6)] == [True, False, False, False, True]
    assert got[2].error == "seq_a is null" and "position 1" in got[3].error and got[4].error == "the guide decreases"
    assert all(got[i][c] is None for i in (2, 3, 4) for c in ("score", "ops", "start_i", "guide_j", "grad")) and got[5].score is not None


def test_settings_and_typed_classes(spark):
    from alignspark.operators import batch as b

    whole = AlignParams(SubstMatrix(3 * np.eye(4) - 1, "ACGT"), 4, 2, 4, 2)
    small = b.PairBatchInt8(pairs_of(spark, 5), whole)
    assert small.precision == "int8" and small.score_and_grad() == PairBatch(pairs_of(spark, 5), whole).score_and_grad()
    pair = b.SeqPairInt8(spark, "ACGT", "ACGT", whole)
    assert pair.align() == 8 and pair.traceback == "auto"
    pair.traceback, pair.hb_cutoff, pair.fill = "hirschberg", 64, "rowwise"
    assert (pair.batch.traceback, pair.batch.hb_cutoff, pair.fill) == ("hirschberg", 64, "rowwise")
    for wrong in (lambda: pair.banded_align(3), lambda: setattr(pair, "fill", "x"), lambda: setattr(pair, "hb_cutoff", 0)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        b.PairBatchInt8(pairs_of(spark, 5), whole * 0.5)
    assert small[-1].first().pair_id == 4
    with pytest.raises(IndexError):
        small[-6]


def test_range_of_soft_sums(spark):
    steep = AlignParams(SubstMatrix(2000 * np.eye(4), "ACGT"), 4, 2, 4, 2)
    pairs = pairs_of(spark, 3)
    with pytest.raises(ValueError, match="beyond the range"):
        align(pairs, steep, Problem(grad="soft", soft_impl="scaled"))
    logs, chosen = (align(pairs, steep, Problem(grad="soft", soft_impl=i)).orderBy("pair_id").collect() for i in ("log", "scaled_or_log"))
    assert logs == chosen
    mild = [align(pairs, PARAMS, Problem(grad="soft", soft_impl=i), ("score", "grad")).orderBy("pair_id").collect() for i in ("log", "scaled")]
    for x, y in zip(*mild, strict=True):
        assert x.score == pytest.approx(y.score, rel=1e-11) and all(y.grad[k] == pytest.approx(v, abs=1e-9) for k, v in x.grad.items() if abs(v) > 1e-9)


def test_published_matrices_come_from_a_folder(spark, tmp_path):
    from alignspark import matrices

    letters = "ARNDCQEGHILKMFPSTWYVBZX*"
    rows = "\n".join(f"{a} " + " ".join(str((i * j) % 7 - 3) for j in range(24)) for i, a in enumerate(letters))
    (tmp_path / "BLOSUM50").write_text("# comment\n  " + " ".join(letters) + "\n" + rows + "\n")
    found = matrices.load(spark, "BLOSUM50", str(tmp_path))
    assert found.alphabet == "ARNDCQEGHILKMFPSTWYVBZX" and found.score("R", "D") == (1 * 3) % 7 - 3
    assert matrices.load(spark, "NUC44", "") is matrices.NUC44
    with pytest.raises(ValueError):
        matrices.load(spark, "BLOSUM51", str(tmp_path))


@pytest.mark.parametrize("mode", ["global", "local", "glocal"])
@pytest.mark.parametrize("model", ["affine", "linear"])
def test_gradients_from_runs_equal_the_kernels(spark, mode, model):
    both = AlignParams.stack([PARAMS, AlignParams(SubstMatrix(5 * np.eye(4) - 3, "ACGT"), 3, 1, 2, 2)])
    pairs = pairs_of(spark, 40, 15, 7).withColumn("track", F.transform(F.split("seq_a", "(?!^)(?!$)"), lambda c, i: (i % 3 % 2).cast("int")))
    pairs = pairs.withColumn("track", F.when(F.length("seq_a") == 0, F.array().cast("array<int>")).otherwise(F.col("track")))
    pairs = pairs.withColumn("gap_track", F.when(F.col("pair_id") % 2 == 0, F.concat(F.array(F.lit(1)), F.transform("track", lambda t: 1 - t))))
    for params, rows in ((both, pairs), (PARAMS, pairs.drop("track", "gap_track"))):
        found = align(rows, params, Problem(mode, model, "hard"), ("score", "path", "grad"))
        want = {(r.pair_id, r.field): r.value for r in gradient.gradient_rows(found).collect()}
        seen = gradient.path_fields(found.join(rows, "pair_id"), params, "pair_id", gap_model=model)
        assert {(r.pair_id, r.field): r.value for r in seen.collect() if r.value} == want
        total = {r.field: r.value for r in gradient.path_fields(found.join(rows, "pair_id"), params, gap_model=model).collect()}
        assert all(v == sum(x for (_, f), x in want.items() if f == k) for k, v in total.items())


def test_table_function_of_gradient_rows(spark):
    from alignspark.functions import sql as sqlfn

    sqlfn.register(spark, PARAMS, "acgt_")
    spark.createDataFrame([(1, "ACGT", "AGT"), (2, None, "A"), (3, "", "")], "pair_id long, seq_a string, seq_b string").createOrReplaceTempView("some_pairs")
    rows = spark.sql("SELECT pair_id, field, value FROM some_pairs, LATERAL acgt_nw_grad_rows_affine(seq_a, seq_b)").collect()
    want = gradient.gradient_rows(align(spark.table("some_pairs").where("seq_a is not null"), PARAMS, Problem("global"), ("score", "grad"))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and rows


@pytest.mark.parametrize("grad", ["hard", "soft"])
def test_sums_without_rows(spark, grad):
    """The sums that tasks form equal those over every pair's row; tracked, guided and empty ones, too."""
    both = AlignParams.stack([PARAMS, AlignParams(SubstMatrix(5 * np.eye(4) - 3, "ACGT"), 3, 1, 2, 2)])
    pairs = pairs_of(spark, 50, 20, 3)
    tracked = pairs.withColumn("track", F.when(F.length("seq_a") == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split("seq_a", "(?!^)(?!$)"), lambda c, i: (i % 2).cast("int"))))
    for params, rows in ((PARAMS, pairs), (both, tracked)):
        batch = PairBatch(None, None, mode="local", grad_mode=grad)
        want = batch.align(rows, params)
        total, summed = batch.align_total(rows, params)
        assert abs(total - want.total) < 1e-9 * abs(total) and np.allclose(summed.flat(), want.grad.flat(), rtol=1e-12, atol=1e-9)
    assert batch.align_total(pairs.limit(0), PARAMS)[0] == 0
    with pytest.raises(Exception, match="pair 7: seq_b is null|pair 7, seq_b|pair 7"):
        batch.align_total(spark.createDataFrame([(7, "AC", None)], "pair_id long, seq_a string, seq_b string"), PARAMS)


def test_views_of_a_batch(spark):
    batch = PairBatch(spark.createDataFrame([(5, "ACGT", "ACT"), (9, "GG", "GG")], "pair_id long, seq_a string, seq_b string"), PARAMS)
    view = batch.pair(9)
    assert (view.seq_a, view.pair_id, view.score_valid, view.path_valid) == ("GG", 9, False, False)
    with pytest.raises(RuntimeError, match="no valid scores"):
        _ = view.score
    batch.score_and_grad(keep_paths=True)
    view = batch.pair(9)
    assert view.score == 4 and view.cigar() == "2M" and view.guide_j == [0, 1, 2] and view.grad.dot(PARAMS) == 4 and batch.pair(-2).seq_a == "ACGT"
    for name, value in (("traceback", "grid"), ("hb_cutoff", 7), ("soft_temperature", 2.0), ("soft_impl", "log")):
        with pytest.raises(RuntimeError, match=f"{name} of a pair in a batch is the batch's"):
            setattr(view, name, value)
    for call in (view.align, view.score_and_grad, view.drop_paths, lambda: view.set_params(PARAMS)):
        with pytest.raises(RuntimeError, match="batch's"):
            call()
    with pytest.raises(IndexError):
        batch.pair(6)


def test_hirschberg_refuses_negative_penalties_past_the_cutoff(spark):
    pairs = spark.createDataFrame([(5, "ACGTACGT", "ACT")], "pair_id long, seq_a string, seq_b string")
    negative = AlignParams(SubstMatrix(6 * np.eye(4) - 4, "ACGT"), -1, 2, 5, 1)
    batch = PairBatch(pairs, negative, traceback="hirschberg", hb_cutoff=4)
    with pytest.raises(ValueError, match="needs gap penalties of 0 or more beyond 4 rows"):
        batch.score_and_grad()
    batch.hb_cutoff = 8
    short = batch.score_and_grad()
    batch.hb_cutoff, batch.traceback = 4, "pointers"
    assert batch.score_and_grad() == short
    falling = AlignParams(SubstMatrix(6 * np.eye(4) - 4, "ACGT"), 1, -2, 5, 1)
    assert PairBatch(pairs, falling, traceback="hirschberg", hb_cutoff=4).score_and_grad() == PairBatch(pairs, falling).score_and_grad()
    with pytest.raises(ValueError, match="beyond 4 rows"):
        PairBatch(pairs, falling, mode="local", traceback="hirschberg_pmax", hb_cutoff=4).score_and_grad()


@pytest.mark.parametrize("guide,says", [([0, 1, 2], "2 entries|3 entries"), ([0, 1, 2, 9], "outside"), ([-1, 1, 2, 3], "outside"), ([0, 2, 1, 3], "decreases")])
def test_one_broken_guide_among_sound_ones_is_named(spark, guide, says):
    rows = [(k, "ACG", "ACG", [0, 1, 2, 3]) for k in range(20)] + [(77, "ACG", "ACG", guide), (78, "ACG", "ACG", None)]
    pairs = spark.createDataFrame(rows, "pair_id long, seq_a string, seq_b string, guide_j array<int>").coalesce(1)
    with pytest.raises(Exception, match=f"pair 77.*({says})"):
        align(pairs, PARAMS, Problem(band=2)).collect()
    errors = {r.pair_id: r.error for r in align(pairs, PARAMS, Problem(band=2), on_error="null").collect()}
    assert errors.pop(77) and not any(errors.values())


def test_pairs_of_small_inputs_are_made_in_many_tasks_without_broadcasts(spark, sf):
    from alignspark import catalog
    from alignspark.operators.pairs import bipartite_pairs, seed_pairs

    a = spark.range(200).selectExpr("id", "id % 2 as k", "md5(string(id)) as s")
    both = bipartite_pairs(a, a, ["k"], "id", "s", "id", "s")
    sizes = [len(x) for x in both.rdd.glom().collect()]
    assert sum(sizes) == 20000 and sum(n > 0 for n in sizes) > 4 and max(sizes) < 10000
    for df in (both, seed_pairs(a, a, 8, "id", "s"), catalog.QUERIES["pairs_seed_join"](spark, sf)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pending_pairs_are_joined_as_they_are(spark):
    from alignspark.operators.pairs import pending_pairs

    done = spark.createDataFrame([(1,), (1,), (3,)], "pair_id long")
    left = pending_pairs(spark.range(5).withColumnRenamed("id", "pair_id"), done, "pair_id")
    assert sorted(r.pair_id for r in left.collect()) == [0, 2, 4]
    assert "Aggregate" not in left._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["nw_score_affine", "nw_score_banded", "hard_grad_dot_params", "compute_grad_total", "best_hit_topk", "score_histogram"])
def test_dna_pairs_are_aligned_where_they_are_joined(spark, sf, name):
    from alignspark import catalog

    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # customers and suppliers, not their pairs
