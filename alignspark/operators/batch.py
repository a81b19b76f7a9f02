"""Batches and pairs with state: full and banded passes, new parameters, gradients, views."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.functions import render
from alignspark.operators import gradient
from alignspark.operators.align import CHOICES, INT_LIMIT, Problem, align, align_summed, choice
from alignspark.operators.numbering import one_each, values_by_position
from alignspark.params import AlignParams
from alignspark.sources.readers import zip_pairs
from alignspark.sources.storage import discard, materialize


@dataclass(frozen=True)
class BatchResult:
    """Scores of a streaming pass as a frame, their sum, and the summed gradient (None without one)."""

    scores: DataFrame
    total: float
    grad: AlignParams | None


class PairBatch:
    """Pairs of one problem type, aligned again and again under changing parameters.

    ``pairs`` has pair_id, seq_a, seq_b and, optionally, track and gap_track.
    The first pass deals the pairs out; its results are written with them, so a
    later pass reads sequences and guides together and shuffles nothing.  Each
    pass deletes the table of the one before it.  Parameters are copied.  ``set_params`` drops scores, gradients and paths and keeps guides.
    """

    #: Number type of typed subclasses.
    PRECISION = "float64"

    def __init__(self, pairs: DataFrame | None, params: AlignParams | None, gap_model: str = "affine", mode: str = "global", grad_mode: str = "hard", precision: str | None = None, **options):
        self._problem = Problem(mode=mode, gap_model=gap_model, grad=grad_mode, precision=precision or self.PRECISION, temperature=options.pop("soft_temperature", 1.0))
        self.hb_cutoff = options.pop("hb_cutoff", 512)
        if int(options.pop("n_threads", 0)) < 0:
            raise ValueError("n_threads must be 0 or more")
        self.options: dict[str, str] = {}
        for name in CHOICES:
            setattr(self, name, options.pop(name, CHOICES[name][0]))
        if options:
            raise TypeError(f"unknown option {next(iter(options))!r}")
        self._pairs, self._results, self._guides, self._has_paths, self._written = pairs, None, None, False, None
        self._params = None
        if params is not None:
            self._problem.check(params)
            self._params = params.copy()

    # settings -----------------------------------------------------------------
    @property
    def params(self) -> AlignParams:
        return self._params.copy()

    @property
    def num_sets(self) -> int:
        return self._params.num_sets

    @property
    def alphabet(self):
        return self._params.alphabet

    mode = property(lambda self: self._problem.mode)
    gap_model = property(lambda self: self._problem.gap_model)
    grad_mode = property(lambda self: self._problem.grad)
    precision = property(lambda self: self._problem.precision)
    soft_temperature = property(lambda self: self._problem.temperature)

    @property
    def hb_cutoff(self) -> int:
        return self._hb_cutoff

    @hb_cutoff.setter
    def hb_cutoff(self, n: int) -> None:
        if int(n) < 1:
            raise ValueError("hb_cutoff must be 1 or more")
        self._hb_cutoff = int(n)

    @soft_temperature.setter
    def soft_temperature(self, t: float) -> None:
        self._problem = replace(self._problem, temperature=t)
        if self._problem.grad == "soft":
            self._results = None

    def __len__(self) -> int:
        return self._need_pairs().count()

    def __getitem__(self, i: int) -> DataFrame:
        """The pair with this id, with whatever has been computed of it; -1 is the pair of the largest id, and so on down."""
        pairs = self._need_pairs()
        wanted = i
        if i < 0:
            last = pairs.select("pair_id").orderBy(F.desc("pair_id")).limit(-i).agg(F.min("pair_id"), F.count(F.lit(1))).first()
            wanted = last[0] if last[1] == -i else None
        rows = pairs.where(F.col("pair_id") == wanted)
        if wanted is None or rows.isEmpty():
            raise IndexError(f"no pair {i}")
        return rows if self._results is None else rows.join(self._results.drop("seq_a", "seq_b", *self._tracks()), "pair_id", "left")

    def pair(self, i: int) -> PairView:
        """A view of one pair: its sequences and its results as plain values."""
        return PairView(self, self[i].first())

    def set_params(self, params: AlignParams) -> None:
        if self._params is not None and (params.alphabet != self._params.alphabet or params.num_sets != self._params.num_sets):
            raise ValueError("new parameters must keep the alphabet and the number of sets")
        self._problem.check(params)
        self._params, self._results, self._has_paths = params.copy(), None, False

    # passes -------------------------------------------------------------------
    def _need_pairs(self) -> DataFrame:
        if self._pairs is None:
            raise RuntimeError("this batch holds no pairs; use align()")
        return self._pairs

    def _laid_out(self) -> tuple[DataFrame, int | None]:
        """(pairs, tasks): the pairs, dealt out and sorted by the first pass; later ones read them, and guides, where they lie."""
        if self._written is None:
            return self._need_pairs().drop("guide_j"), None
        return self._written.select("pair_id", "seq_a", "seq_b", *self._tracks(), "guide_j"), 0

    def _tracks(self) -> list[str]:
        return [c for c in ("track", "gap_track") if c in self._need_pairs().columns]

    def _pass(self, pairs: DataFrame, tasks: int | None, problem: Problem, keep_paths: bool) -> float:
        self._results, self._has_paths = None, False  # a failed pass leaves nothing that looks valid
        problem = replace(problem, posterior=self.soft_guide == "posterior" and problem.grad == "soft", soft_impl=self.soft_impl, soft_precision=self.soft_precision)
        problem.check(self._params)
        self._check_splits(pairs)
        outputs = ["score", "guide"] + ["path"] * keep_paths + ["grad"] * (problem.grad != "none")
        before = self._written  # this pass may read its pairs and guides
        aligned = align(pairs, self._params, problem, tuple(outputs), tasks=tasks, keep=("seq_a", "seq_b", *self._tracks()))
        self._results = self._written = materialize(aligned, "alignments")
        if before is not None:
            discard(before)
        self._guides, self._has_paths = self._results.select("pair_id", "guide_j"), keep_paths
        return gradient.total(self._results)

    def score_and_grad(self, keep_paths: bool = False) -> float:
        """Align every pair in full; returns the sum of scores."""
        pairs, tasks = self._laid_out()
        return self._pass(pairs.drop("guide_j"), tasks, self._problem, keep_paths)

    def banded_grad(self, bandwidth: int, keep_paths: bool = False) -> float:
        """Align every pair within ``bandwidth`` columns of the path of the pass before."""
        if bandwidth <= 0:
            raise ValueError(f"the bandwidth must be above 0, got {bandwidth}")
        if self._guides is None:
            raise RuntimeError("no guide yet: run score_and_grad first")
        self._check_band()
        return self._pass(*self._laid_out(), replace(self._problem, band=bandwidth), keep_paths)

    def _check_splits(self, pairs: DataFrame) -> None:
        """An explicit Hirschberg traceback divides pairs of more than ``hb_cutoff`` rows, which some negative penalties forbid."""
        if not self.traceback.startswith("hirschberg"):
            return
        opens, extends = self._params.gaps[:, [0, 2]], self._params.gaps[:, [1, 3]]
        negative = self.gap_model == "affine" and (opens < 0).any() or self.mode == "local" and (extends < 0).any()
        if negative and not pairs.where(F.length("seq_a") > self.hb_cutoff).isEmpty():
            raise ValueError(f"traceback {self.traceback!r} needs gap penalties of 0 or more beyond {self.hb_cutoff} rows; use 'pointers' or 'auto'")

    def _check_band(self) -> None:
        if self.traceback.startswith("hirschberg"):
            raise ValueError(f"traceback {self.traceback!r} cannot be combined with a band")

    def align(self, pairs: DataFrame, params: AlignParams, band: int = 0) -> BatchResult:
        """Align other pairs, once, and keep nothing of them in this batch.

        Guided and unguided pairs may be mixed only with a band.
        """
        problem = replace(self._problem, band=band, soft_impl=self.soft_impl, soft_precision=self.soft_precision)
        problem.check(params)
        if band:
            self._check_band()
        if "guide_j" in pairs.columns and band == 0 and not pairs.where("guide_j is null").isEmpty() and not pairs.where("guide_j is not null").isEmpty():
            raise ValueError("guided and unguided pairs cannot be mixed without a band")
        if problem.grad == "none":
            scores = materialize(align(pairs, params, problem), "scores")
            return BatchResult(scores, gradient.total(scores), None)
        rows = materialize(align(pairs, params, problem, ("score", "grad")), "scores")
        return BatchResult(rows.select("pair_id", "score"), gradient.total(rows), gradient.to_params(gradient.summed(rows), params))

    def align_total(self, pairs: DataFrame, params: AlignParams, band: int = 0) -> tuple[float, AlignParams]:
        """The sums of :meth:`align` alone, of scores and gradients: nothing is written or shuffled of any one pair."""
        problem = replace(self._problem, band=band, soft_impl=self.soft_impl, soft_precision=self.soft_precision)
        if band:
            self._check_band()
        rows = align_summed(pairs, params, problem).collect()  # a row a parameter at most
        flat = params.flat() * 0.0
        for r in rows:
            if r.field is not None:
                flat[r.field] = r.value
        return next((r.total for r in rows if r.field is None), 0.0), params.like_flat(flat)

    # results ------------------------------------------------------------------
    def _valid(self, what: str) -> DataFrame:
        if self._results is None:
            raise RuntimeError(f"no valid {what}: align first")
        return self._results

    def scores(self) -> DataFrame:
        return self._valid("scores").select("pair_id", "score")

    def guides(self) -> DataFrame:
        if self._guides is None:
            raise RuntimeError("no guides yet")
        return self._guides

    def _graded(self) -> DataFrame:
        rows = self._valid("gradient")
        if "grad" not in rows.columns:
            raise RuntimeError("grad_mode is none: there is no gradient")
        return rows

    def compute_grad(self, in_order: bool = False) -> AlignParams:
        """The sum of all gradients; ``in_order`` fixes the order of additions."""
        rows = self._graded()
        if rows.isEmpty():
            raise RuntimeError("an empty batch has no gradient")
        return gradient.to_params(gradient.summed_in_order(rows) if in_order else gradient.summed(rows), self._params)

    def weighted_grad(self, weights: DataFrame | Sequence[float]) -> AlignParams:
        """The sum of gradients times weights: a frame (pair_id, weight), or one number a pair in the order of their ids.

        Every pair needs exactly one weight, whatever the ids are.
        """
        rows = self._graded()
        if isinstance(weights, DataFrame):
            one_each(rows, weights, "weight")
        else:
            weights = values_by_position(rows, weights, "weight")
        return gradient.to_params(gradient.weighted(rows, weights), self._params)

    def grads(self) -> DataFrame:
        return gradient.dense(self._graded(), self._params)

    # views --------------------------------------------------------------------
    def _paths(self) -> DataFrame:
        rows = self._valid("path")
        if not self._has_paths:
            raise RuntimeError("no stored paths: align with keep_paths=True")
        return rows

    def _view(self, name: str, column) -> DataFrame:
        return self._paths().select("pair_id", column.alias(name))

    def _aligned(self):
        return render.aligned(*map(F.col, ("seq_a", "seq_b", "ops", "start_i", "start_j")))

    def aligned(self) -> DataFrame:
        return self._view("aligned", self._aligned())

    def coordinates(self) -> DataFrame:
        return self._view("coordinates", render.coordinates(F.col("ops"), F.col("start_i"), F.col("start_j")))

    def cigars(self, extended: bool = False, soft_clip: bool = False) -> DataFrame:
        return self._view("cigar", render.cigar(*map(F.col, ("seq_a", "seq_b", "ops", "start_i", "start_j")), extended=extended, soft_clip=soft_clip))

    def formatted(self, width: int = 60) -> DataFrame:
        rows = self._paths().select("pair_id", self._aligned().alias("al"))
        return rows.select("pair_id", render.formatted(F.col("al"), width).alias("formatted"))

    def drop_paths(self) -> None:
        """Forget paths; scores, gradients and guides stay."""
        if self._has_paths:
            self._results, self._has_paths = self._results.drop("ops", "start_i", "start_j", "end_i", "end_j"), False


def _setting(name: str):
    def put(self, value: str) -> None:
        if name == "soft_precision":
            replace(self._problem, soft_precision=value)  # refuses what this number type cannot have
        self.options[name] = choice(name, value, CHOICES[name])

    return property(lambda self: self.options[name], put, doc=f"One of {', '.join(CHOICES[name])}.")


for _name in CHOICES:
    setattr(PairBatch, _name, _setting(_name))


class SeqPair:
    """One pair as a batch of one row, with its results as plain values.

    Reading what is not valid (before a pass, or after new parameters) raises.
    """

    BATCH = PairBatch

    def __init__(self, spark: SparkSession, seq_a: str, seq_b: str, params: AlignParams, gap_model: str = "affine", mode: str = "global", grad_mode: str = "hard", *, track=None, gap_track=None, **options):
        for s in (seq_a, seq_b):
            params.alphabet.codes(s)
        row = zip_pairs(spark, [seq_a], [seq_b])
        for name, t in (("track", track), ("gap_track", gap_track)):
            if t is not None:
                row = row.withColumn(name, F.array(*map(F.lit, t)).cast("array<int>"))
        self.seq_a, self.seq_b = seq_a, seq_b
        self.batch = self.BATCH(row, params, gap_model, mode, grad_mode, **options)

    def align(self, keep_paths: bool = True) -> float:
        return self.batch.score_and_grad(keep_paths)

    def banded_align(self, bandwidth: int, keep_paths: bool = True) -> float:
        return self.batch.banded_grad(bandwidth, keep_paths)

    def score_and_grad(self, keep_paths: bool = True) -> tuple[float, AlignParams]:
        if self.batch.grad_mode == "none":
            raise RuntimeError("grad_mode is none: use align()")
        return self.batch.score_and_grad(keep_paths), self.grad

    def set_params(self, params: AlignParams) -> None:
        self.batch.set_params(params)

    def drop_paths(self) -> None:
        self.batch.drop_paths()

    score_valid = property(lambda self: self.batch._results is not None)
    grad_valid = property(lambda self: self.score_valid and self.batch.grad_mode != "none")
    path_valid = property(lambda self: self.batch._guides is not None)
    stored_path_valid = property(lambda self: self.batch._has_paths)

    @property
    def score(self) -> float:
        return self.batch.scores().first()["score"]

    @property
    def grad(self) -> AlignParams:
        return self.batch.compute_grad()

    @property
    def guide_j(self) -> list[int]:
        return list(self.batch.guides().first()["guide_j"])

    def aligned(self) -> tuple[str, str]:
        return tuple(self.batch.aligned().first()["aligned"])

    def coordinates(self) -> tuple[list[int], list[int]]:
        return tuple(map(list, self.batch.coordinates().first()["coordinates"]))

    def cigar(self, *, extended: bool = False, soft_clip: bool = False) -> str:
        return self.batch.cigars(extended, soft_clip).first()["cigar"]

    def formatted(self, width: int = 60) -> str:
        return self.batch.formatted(width).first()["formatted"]


def _passed_on(name: str):
    return property(lambda self: getattr(self.batch, name), lambda self, value: setattr(self.batch, name, value))


for _name in (*CHOICES, "hb_cutoff", "soft_temperature"):
    setattr(SeqPair, _name, _passed_on(_name))

class PairView(SeqPair):
    """One pair of a batch: it reads what the batch's passes left, and has no settings of its own."""

    def __init__(self, batch: PairBatch, row):
        one = copy(batch)
        only = F.col("pair_id") == row["pair_id"]
        one._pairs = batch._pairs.where(only)
        one._results = batch._results if batch._results is None else batch._results.where(only)
        one._guides = batch._guides if batch._guides is None else batch._guides.where(only)
        self.__dict__.update(seq_a=row["seq_a"], seq_b=row["seq_b"], pair_id=row["pair_id"], batch=one)

    def __setattr__(self, name: str, value) -> None:
        raise RuntimeError(f"{name} of a pair in a batch is the batch's: set it on the batch, which applies to every pair")

    def _of_the_batch(self, *_, **__):
        raise RuntimeError("a pair in a batch is aligned by the batch's passes, under the batch's parameters")

    align = banded_align = score_and_grad = set_params = drop_paths = _of_the_batch


#: A batch and a pair class for each number type: PairBatchInt8, SeqPairInt8, ..., PairBatchFloat32, SeqPairFloat32.
for _type in (*INT_LIMIT, "float32"):
    _suffix = _type.capitalize()
    _batch = type(f"PairBatch{_suffix}", (PairBatch,), {"PRECISION": _type, "__doc__": f"A batch whose scores are {_type}.", "__module__": __name__})
    globals()[_batch.__name__] = _batch
    globals()[f"SeqPair{_suffix}"] = type(f"SeqPair{_suffix}", (SeqPair,), {"BATCH": _batch, "__doc__": f"A pair whose score is {_type}.", "__module__": __name__})
