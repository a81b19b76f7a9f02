"""The alignment operator: a DataFrame of pairs in, scores, paths, guides and gradients out.

Pairs are dealt out by a hash first (a pair's cells cost far more than moving
its letters, and joins that make pairs often leave them in one partition), then
one Arrow pass over the columns that it needs.  Pairs of similar lengths are
packed into blocks within each batch, and parameters travel once a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.params import AlignParams
from alignspark.plans import kernel as kn

#: Cells that one block fills at most (a longer pair is a block of its own); ensembles hold some ten times as much a cell.
BLOCK_CELLS, SOFT_CELLS = 8_000_000, 2_000_000
#: Cells from which a pair whose scores are edit distances is filled a bit a cell.
EDIT_CELLS = 1 << 16
OPS = "array<struct<op:tinyint,len:int>>"

GRADS = ("hard", "soft", "none")
#: Ways in which the same result can be asked for.  ``soft_impl`` and ``soft_precision`` say how sums over all paths are formed
#: (see :func:`ways`); the others are accepted and change nothing.
CHOICES = {
    "traceback": ("auto", "scores", "pointers", "hirschberg", "hirschberg_pmax", "grid"),
    "kernel": ("auto", "scalar", "simd"),
    "fill": ("striped", "rowwise"),
    "soft_impl": ("scaled", "log", "scaled_or_log"),
    "soft_guide": ("eager", "lazy", "posterior"),
    "soft_precision": ("double", "float32"),
}
#: The largest absolute value that each integer type is used for.
INT_LIMIT = {"int8": 127, "int16": 16383, "int32": 1073741823, "int64": 4611686018427387903}
INT_MARGIN = 66
#: Largest step whose probability is a finite double.
LARGEST_STEP = 709.0
#: How the sums of a pair are formed, in the order in which they are tried.
WAYS = ("float32", "plain", "float64", "log")
#: With steps beyond this few pairs' rescaled sums are sound, so a free choice goes to logarithms at once.
WORTH_A_TRY = 100.0


def choice(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {name} {value!r}: expected one of {', '.join(allowed)}")
    return value


@dataclass(frozen=True)
class Problem:
    """What is computed of each pair."""

    mode: str = "global"
    gap_model: str = "affine"
    grad: str = "hard"
    precision: str = "float64"
    temperature: float = 1.0
    band: int = 0
    posterior: bool = False
    soft_impl: str = "scaled_or_log"
    soft_precision: str = "double"

    def __post_init__(self):
        choice("mode", self.mode, kn.MODES)
        choice("gap_model", self.gap_model, kn.MODELS)
        choice("grad_mode", self.grad, GRADS)
        choice("precision", self.precision, ("float32", "float64", *INT_LIMIT))
        choice("soft_impl", self.soft_impl, CHOICES["soft_impl"])
        if choice("soft_precision", self.soft_precision, CHOICES["soft_precision"]) == "float32" and self.precision != "float32":
            raise ValueError("soft_precision='float32' needs precision='float32'")
        if self.band < 0:
            raise ValueError(f"band must be 0 or more, got {self.band}")
        if self.grad == "soft" and self.precision in INT_LIMIT:
            raise ValueError("integer types have no soft mode")
        if not (math.isfinite(self.temperature) and self.temperature > 0):
            raise ValueError("the temperature must be finite and above 0")

    def check(self, params: AlignParams) -> None:
        if self.precision in INT_LIMIT:
            flat = params.flat()
            bad = flat[(flat != np.rint(flat)) | (np.abs(flat) > INT_LIMIT[self.precision])]
            if len(bad):
                raise ValueError(f"{self.precision} needs integral parameters of at most {INT_LIMIT[self.precision]}, got {bad[0]}")
        if self.grad == "soft" and self.soft_impl == "scaled" and (step := kn.step_bound(self.scoring(params))) > LARGEST_STEP:
            raise ValueError(f"a step of {step:g} is beyond the range of soft_impl='scaled' ({LARGEST_STEP:g}); use 'scaled_or_log' or 'log'")

    def scoring(self, params: AlignParams, steps: int = 1 << 62) -> kn.Scoring:
        """Parameters for paths of up to ``steps`` moves.  Integral ones whose sums stay below 2^24 are exact in 32 bits, too."""
        kind = np.float32 if self.precision == "float32" and self.grad != "soft" else np.float64
        flat = params.flat()
        if self.grad != "soft" and (flat == np.rint(flat)).all() and 2 * steps * float(np.abs(flat).max()) < 1 << 24:
            kind = np.float32
        t = self.temperature if self.grad == "soft" else 1.0
        return kn.Scoring((params.matrices / t).astype(kind).ravel(), (params.gaps / t).astype(kind), len(params.alphabet), self.mode, self.gap_model)


def ways(p: Problem, s: kn.Scoring, m: np.ndarray, n: np.ndarray, forward_only: bool = False) -> np.ndarray:
    """How each pair's sums over all paths are formed first, as a place in WAYS.

    Plain doubles where no sum can leave their range; else rescaled ones, unless a step itself is too large for them.  With
    ``soft_precision`` float32, rescaled floats come before either.  Pairs whose rescaled sums may have lost too much to
    underflow go on to the next way (:func:`next_way`), at last to logarithms; ``soft_impl`` "scaled" refuses them instead.
    ``forward_only`` totals need no backward sweep in logarithms, so a free choice takes these rather than rescaled doubles.
    """
    if p.soft_impl == "log":
        return np.full(len(m), 3)
    step = kn.step_bound(s)
    rescale = step < kn.RESCALED["float64"][0] and (p.soft_impl == "scaled" or step < WORTH_A_TRY and not forward_only)
    way = np.where(kn.in_range(s, m, n), 1, 2 if rescale else 3)
    return np.zeros_like(way) if p.soft_precision == "float32" and step < kn.RESCALED["float32"][0] else way


def next_way(way: int, fits: bool) -> int:
    """The way after one that was not sound; ``fits``: plain doubles do."""
    return (1 if fits else 2) if way == 0 else 3


def _rows(m: np.ndarray, n: np.ndarray, apart: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Pairs of similar lengths, in blocks of ``most`` cells; ``apart`` holds kinds of pairs that share none.

    Lengths within a quarter of an octave go together, so padding costs a tenth or so of the cells.
    """
    bucket = lambda x: np.floor(4 * np.log2(x + 16.0)).astype(np.int64)
    kind = (bucket(m) * 1024 + bucket(n)) * 8 + apart
    order = np.lexsort((n, m, kind))
    edges = np.flatnonzero(np.diff(kind[order])) + 1
    for group in np.split(order, edges):
        at = 0
        while at < len(group):
            rest = group[at:]
            cells = (int(m[rest].max()) + 1) * (int(m[rest].max()) + int(n[rest].max()) + 1)
            take = max(1, min(len(rest), most // cells))
            yield rest[:take]
            at += take


def guide_fault(g: np.ndarray, m: int, n: int) -> str | None:
    if len(g) != m + 1:
        return f"the guide has {len(g)} entries, a sequence of length {m} needs {m + 1}"
    if len(g) and (g.min() < 0 or g.max() > n):
        return f"a guide entry is outside [0, {n}]"
    return "the guide decreases" if (np.diff(g) < 0).any() else None


def track_fault(t: np.ndarray, g: np.ndarray, m: int, k_sets: int) -> str | None:
    if len(t) != m or len(g) != m + 1:
        return "a track needs one entry a residue and a gap track one more"
    if min(t.min(initial=0), g.min(initial=0)) < 0 or max(t.max(initial=0), g.max(initial=0)) >= k_sets:
        return f"a track names a set outside [0, {k_sets})"
    return None


class Lists:
    """One list a pair, in the pairs' order, gathered from blocks of pairs."""

    def __init__(self, n: int, *kinds):
        self.size, self.first, self.flat, self.length = np.zeros(n, np.int64), np.zeros(n, np.int64), [[np.zeros(0, k)] for k in kinds], 0

    def add(self, at: np.ndarray, edges: np.ndarray, *values: np.ndarray) -> None:
        """The lists of pairs ``at``: values[edges[k]:edges[k + 1]]."""
        self.size[at], self.first[at] = np.diff(edges), self.length + edges[:-1]
        self.length += len(values[0])
        for flat, v in zip(self.flat, values, strict=True):
            flat.append(v)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(offsets, values ...)"""
        edges = np.concatenate([[0], np.cumsum(self.size)])
        pick = np.arange(edges[-1]) + np.repeat(self.first - edges[:-1], self.size)
        return edges.astype(np.int32), *(np.concatenate(flat)[pick].astype(flat[0].dtype) for flat in self.flat)


def _lists(column: pa.Array) -> list:
    """A column of lists of numbers as arrays, None where it is null; they share its memory."""
    if column.values.null_count:
        return column.to_pylist()
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    some = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [values[x:y] if ok else None for x, y, ok in zip(edges, edges[1:], some)]


def _all_sound(guides: list, a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    """Whether no guide has a fault, looked at together."""
    at = [i for i, g in enumerate(guides) if g is not None]
    if not at:
        return True
    size = np.fromiter((len(guides[i]) for i in at), np.int64, len(at))
    if (size != [len(a[i]) + 1 for i in at]).any():
        return False
    flat = np.concatenate([guides[i] for i in at])
    if flat.dtype.kind not in "iu":
        return False
    falls = np.diff(flat) < 0
    falls[np.cumsum(size)[:-1] - 1] = False  # from one guide to the next
    return flat.min() >= 0 and bool((flat <= np.repeat([len(b[i]) for i in at], size)).all()) and not falls.any()


def faults(a: list[np.ndarray], b: list[np.ndarray], params: AlignParams, guides=None, tracks=None, gap_tracks=None) -> dict[int, str]:
    """What is wrong with the pairs' guides and tracks."""
    out: dict[int, str] = {}
    if guides is not None and _all_sound(guides, a, b):
        guides = None
    if guides is None and tracks is None and gap_tracks is None:
        return out
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        fault = guide_fault(np.asarray(guides[i], np.int64), len(x), len(y)) if guides is not None and guides[i] is not None else None
        if not fault and (tracks is not None or gap_tracks is not None):
            fault = track_fault(*_tracks(i, len(x), tracks, gap_tracks), len(x), params.num_sets)
        if fault:
            out[i] = fault
    return out


def _tracks(i: int, m: int, tracks, gap_tracks) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a pair's residues and of its rows; a row of gaps takes its residue's set by default."""
    t = np.zeros(m, np.int64) if tracks is None or tracks[i] is None else np.asarray(tracks[i], np.int64)
    g = np.concatenate([t[:1] if len(t) else np.zeros(1, np.int64), t]) if gap_tracks is None or gap_tracks[i] is None else np.asarray(gap_tracks[i], np.int64)
    return t, g


def solve_arrays(ids: list, a: list[np.ndarray], b: list[np.ndarray], params: AlignParams, p: Problem, guides=None, tracks=None, gap_tracks=None, paths: bool = True, gradient: bool = True, together: bool = False, bounded: bool = False) -> dict:
    """Results as arrays over all pairs: score; with ``paths`` ops, guide, start and end; with a gradient, grad.

    ``together`` sums the gradient over all pairs: grad is an array over the fields.  ``bounded``: see :func:`align`.
    """
    k_sets, total = params.num_sets, len(ids)
    m, n = (np.fromiter(map(len, x), np.int64, total) for x in (a, b))
    if p.precision in INT_LIMIT and total:
        worst = int((m + n).max()) + INT_MARGIN
        if worst * kn.step_bound(p.scoring(params)) > INT_LIMIT["int16" if p.precision == "int8" else p.precision]:
            raise OverflowError(f"a score of {p.precision} may overflow: {worst} steps of up to {kn.step_bound(p.scoring(params)):g}")
    soft = p.grad == "soft"
    want_grad = p.grad == "hard" or soft and gradient
    best_paths = not soft or (paths and not p.posterior)
    way, refused = ways(p, p.scoring(params), m, n, not (gradient or p.posterior or bounded)) if soft else np.zeros(total, np.int64), {}
    fits = kn.in_range(p.scoring(params), m, n) if soft else None
    score, ends = np.zeros(total), np.zeros((4, total), np.int32)
    grads, ops, columns = Lists(total, np.int32, np.float64), Lists(total, np.int8, np.int32), Lists(total, np.int32)
    sums = np.zeros(k_sets * params.n_fields) if together else None
    if soft and p.soft_impl == "scaled":
        refused = {i: f"steps of {kn.step_bound(p.scoring(params)):g} are too large for rescaled sums; use soft_impl 'scaled_or_log' or 'log'" for i in np.flatnonzero(way == 3).tolist()}
    by_bits = np.zeros(total, bool)
    if not soft and guides is None and tracks is None and gap_tracks is None and not p.band and kn.is_unit(p.scoring(params)):
        by_bits = m * n >= EDIT_CELLS
    rest = np.flatnonzero(~by_bits)
    todo = [rest[x] for x in _rows(m[rest], n[rest], way[rest], SOFT_CELLS if soft else BLOCK_CELLS)][::-1] + np.flatnonzero(by_bits)[:, None].tolist()
    while todo:
        at = np.asarray(todo.pop())
        bm, bn = m[at], n[at]
        rows, cols = int(bm.max()), int(bn.max())
        s = p.scoring(params, rows + cols + 2)
        block = kn.Block(kn.pad([a[i] for i in at], rows, np.uint8), kn.pad([b[i] for i in at], cols, np.uint8), bm, bn)
        if k_sets > 1 or tracks is not None or gap_tracks is not None:
            sets = [_tracks(i, x, tracks, gap_tracks) for i, x in zip(at, bm.tolist(), strict=True)]
            block.track, block.gap_track = kn.pad([t for t, _ in sets], rows, np.int64), kn.pad([g for _, g in sets], rows + 1, np.int64)
        if guides is not None or p.band:
            if guides is None:  # pairs of the same lengths have the same band
                kinds, of_pair = np.unique(np.stack([bm, bn]), axis=1, return_inverse=True)
                low, high = kn.band_columns([kn.default_guide(x, y) for x, y in kinds.T.tolist()], kinds[1], p.band, p.mode)
                block.low, block.high = low[:, of_pair.ravel()], high[:, of_pair.ravel()]
            else:
                chosen = [kn.default_guide(x, y) if guides[i] is None else np.asarray(guides[i], np.int64) for i, x, y in zip(at, bm.tolist(), bn.tolist(), strict=True)]
                block.low, block.high = kn.band_columns(chosen, bn, p.band, p.mode)
        grad = hard = post = None
        if soft:
            log_z, grad, post, sound = kn.forward_backward(block, s, want_grad, p.posterior, WAYS[way[at[0]]], bounded)
            if sound is not None and not sound.all():  # the others once more without them
                for i in at[~sound].tolist():
                    way[i] = next_way(int(way[i]), bool(fits[i]))
                    if way[i] == 3 and p.soft_impl == "scaled":
                        refused[i] = f"{len(a[i])} by {len(b[i])} letters: rescaled sums may lose more than 2^-45 to underflow; use soft_impl 'scaled_or_log' or 'log'"
                todo += [x for x in (at[sound], *(at[~sound & (way[at] == w)] for w in (1, 2, 3))) if len(x)]
                continue
            score[at] = log_z * p.temperature
        if best_paths:
            hard = kn.edits(block, paths or p.grad == "hard") if by_bits[at[0]] else kn.viterbi(block, replace(s), paths or p.grad == "hard")
            if not soft:
                score[at] = hard[0].score
            if p.grad == "hard":
                grad = kn.path_counts(block, s, *hard, together)
        if together:
            sums += np.bincount(grad[1], weights=grad[2], minlength=len(sums))
        elif grad is not None:
            grads.add(at, np.searchsorted(grad[0], np.arange(len(at) + 1)), *grad[1:])
        if post is not None:
            columns.add(at, np.concatenate([[0], np.cumsum(bm + 1)]), np.concatenate(post))
        if paths and hard is not None:
            e, moves, count = hard
            ops.add(at, *kn.runs(moves, count))
            ends[:, at] = e.start_i, e.start_j, e.i, e.j
            if post is None:
                guide = kn.guides(block, e, moves, count)
                columns.add(at, np.concatenate([[0], np.cumsum(bm + 1)]), guide[np.arange(rows + 1)[None, :] <= bm[:, None]])
    out = {"score": score}
    if soft:
        out["way"], out["refused"] = way, refused
    if want_grad:
        out["grad"] = sums if together else grads.arrays()
    if paths or p.posterior:
        out["guide"] = columns.arrays()
    if paths and best_paths:
        out["ops"], out["ends"] = ops.arrays(), ends
    return out


def solve(ids: list, a: list[np.ndarray], b: list[np.ndarray], params: AlignParams, p: Problem, guides=None, tracks=None, gap_tracks=None, paths: bool = True) -> list[dict]:
    """One result a pair, for a handful of pairs: score, and with ``paths`` ops, start, end, guide; with a gradient, its fields."""
    for i, fault in faults(a, b, params, guides, tracks, gap_tracks).items():
        raise ValueError(f"pair {ids[i]}: {fault}")
    found = solve_arrays(ids, a, b, params, p, guides, tracks, gap_tracks, paths)
    for i, fault in found.get("refused", {}).items():
        raise ValueError(f"pair {ids[i]}: {fault}")
    out: list[dict] = [{"score": float(x)} for x in found["score"]]
    for name in ("grad", "ops", "guide"):
        if name in found:
            edges, *values = found[name]
            for k, r in enumerate(out):
                parts = tuple(v[edges[k] : edges[k + 1]] for v in values)
                r[name] = parts if len(parts) > 1 else parts[0]
    if "ends" in found:
        for r, e in zip(out, found["ends"].T.tolist(), strict=True):
            r["start"], r["end"] = tuple(e[:2]), tuple(e[2:])
    return out


def encode_all(texts: pa.Array, params: AlignParams, which: str) -> tuple[list[np.ndarray], dict[int, str]]:
    """(codes of each text, what is wrong with some): a batch is encoded as a whole."""
    wrong: dict[int, str] = {int(i): f": {which} is null" for i in np.flatnonzero(texts.is_null().to_numpy(zero_copy_only=False))} if texts.null_count else {}
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    base, end = int(edges[0]), int(edges[-1])
    flat = params.alphabet.table[np.frombuffer(texts.buffers()[2], np.uint8)[base:end]] if end > base else np.zeros(0, np.uint8)
    edges = edges - base
    bad = np.flatnonzero(flat == 255)
    for i in np.unique(np.searchsorted(edges, bad, side="right") - 1).tolist():
        try:
            params.alphabet.codes(texts[i].as_py())
        except ValueError as e:
            wrong[i] = f", {which}: {e}"
    at = edges.tolist()
    return [flat[x:y] for x, y in zip(at, at[1:])], wrong


def dealt(pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pairs dealt out over ``tasks`` tasks by a hash, and sorted by length within each.

    By default four tasks a core or the session's shuffle partitions, whichever is more; 0 leaves them where they are.
    """
    if tasks == 0 or pairs.isStreaming:
        return pairs
    spark = pairs.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return pairs.repartition(tasks, F.xxhash64("pair_id", "seq_a", "seq_b")).sortWithinPartitions(F.length("seq_a"), F.length("seq_b"))


def align(pairs: DataFrame, params: AlignParams, problem: Problem = Problem(), outputs: tuple[str, ...] = ("score",), id_col: str = "pair_id", on_error: str = "raise", tasks: int | None = None, keep: tuple[str, ...] = (), bounded: bool = False) -> DataFrame:
    """Align every row's ``seq_a`` and ``seq_b``.

    ``guide_j``, ``track`` and ``gap_track`` are used where those columns exist
    (null: the default).  Outputs: ``score``; ``path`` adds ops, start_i,
    start_j, end_i, end_j; ``guide`` adds guide_j; ``grad`` adds the gradient as
    a map from the field's number in the flat form to its value.

    A null sequence, a foreign character, a malformed guide or track fails the
    job; with ``on_error="null"`` such a pair's outputs are null and a column
    ``error`` says why (null for the others).  ``tasks``: see :func:`dealt`.
    ``keep`` names columns that pass through; they must be among those read.
    ``way`` adds how a pair's sums over all paths were formed, one of WAYS.
    ``bounded`` forms and refuses these as gradients would, though none is formed.
    """
    problem.check(params)
    choice("on_error", on_error, ("raise", "null"))
    wanted = [choice("output", o, ("score", "path", "guide", "grad", "way")) for o in outputs]
    if "way" in wanted and problem.grad != "soft":
        raise ValueError("only sums over all paths (grad 'soft') have a way")
    if "grad" in wanted and problem.grad == "none":
        raise ValueError("grad_mode is none: there is no gradient")
    if "grad" not in wanted and problem.grad == "hard":
        problem = replace(problem, grad="none")
    extra = [c for c in ("guide_j", "track", "gap_track") if c in pairs.columns]
    kind = pairs.schema[id_col].dataType.simpleString()
    src = dealt(pairs.select(F.col(id_col).alias("pair_id"), "seq_a", "seq_b", *(F.col(c).cast("array<int>").alias(c) for c in extra)), tasks)
    schema = [f"`{id_col}` {kind}", "score double"]
    if "path" in wanted:
        schema += [f"ops {OPS}", "start_i int", "start_j int", "end_i int", "end_j int"]
    if "guide" in wanted:
        schema.append("guide_j array<int>")
    if "grad" in wanted:
        schema.append("grad map<int,double>")
    if "way" in wanted:
        schema.append("way string")
    if on_error == "null":
        schema.append("error string")
    kept = [src.columns.index(choice("column to keep", c, tuple(src.columns[1:]))) for c in keep]
    schema += [f"{c} {src.schema[c].dataType.simpleString()}" for c in keep]
    paths = "path" in wanted or "guide" in wanted
    names = [x.split()[0].strip("`") for x in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, wrong), (b, wrong_b) = (encode_all(batch.column(k + 1), params, which) for k, which in enumerate(("seq_a", "seq_b")))
            given = {c: _lists(batch.column(3 + k)) for k, c in enumerate(extra)}
            wrong = wrong_b | wrong
            for i in wrong:
                a[i] = b[i] = a[i][:0]
                for values in given.values():
                    values[i] = None
            more = faults(a, b, params, given.get("guide_j"), given.get("track"), given.get("gap_track"))
            for i in more:
                for values in given.values():
                    values[i] = None
            wrong |= {i: f": {fault}" for i, fault in more.items()}
            if wrong and on_error == "raise":
                i = min(wrong)
                raise ValueError(f"pair {batch.column(0)[i].as_py()}{wrong[i]}")
            found = solve_arrays(range(len(a)), a, b, params, problem, given.get("guide_j"), given.get("track"), given.get("gap_track"), paths, "grad" in wanted, bounded=bounded)
            if late := found.get("refused"):
                if on_error == "raise":
                    raise ValueError(f"pair {batch.column(0)[min(late)].as_py()}: {late[min(late)]}")
                wrong |= {i: f": {fault}" for i, fault in late.items() if i not in wrong}
            cols = [pa.array(found["score"])]
            if "path" in wanted:
                edge, op, length = found["ops"]
                cols.append(pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(op), pa.array(length)], ["op", "len"])))
                cols += map(pa.array, found["ends"])
            if "guide" in wanted:
                cols.append(pa.ListArray.from_arrays(*map(pa.array, found["guide"])))
            if "grad" in wanted:
                cols.append(pa.MapArray.from_arrays(*map(pa.array, found["grad"])))
            if "way" in wanted:
                cols.append(pa.array([WAYS[w] for w in found["way"].tolist()], pa.string()))
            if on_error == "null":
                good = pa.array([None if i in wrong else i for i in range(len(a))], pa.int64())
                cols = [c.take(good) for c in cols] + [pa.array([wrong[i].lstrip(":, ") if i in wrong else None for i in range(len(a))], pa.string())]
            cols += [batch.column(k) for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return src.mapInArrow(run, ", ".join(schema))


def align_summed(pairs: DataFrame, params: AlignParams, problem: Problem = Problem(), tasks: int | None = None) -> DataFrame:
    """(n, total, field, value): the gradient summed over all pairs, nothing kept of any one.

    Each task sums its pairs where they are aligned and returns one row a field
    that they touch.  The row without a field has the number of pairs and the sum
    of their scores.  Sums of fractions may differ in their last bits from run to
    run; :func:`alignspark.operators.gradient.summed_in_order` fixes their order.
    """
    problem.check(params)
    if problem.grad == "none":
        raise ValueError("grad_mode is none: there is no gradient")
    extra = [c for c in ("guide_j", "track", "gap_track") if c in pairs.columns]
    src = dealt(pairs.select("pair_id", "seq_a", "seq_b", *(F.col(c).cast("array<int>").alias(c) for c in extra)), tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, total = np.zeros(params.num_sets * params.n_fields), 0, 0.0
        for batch in batches:
            (a, wrong), (b, wrong_b) = (encode_all(batch.column(k + 1), params, which) for k, which in enumerate(("seq_a", "seq_b")))
            given = {c: _lists(batch.column(3 + k)) for k, c in enumerate(extra)}
            if wrong := wrong_b | wrong:
                raise ValueError(f"pair {batch.column(0)[min(wrong)].as_py()}{wrong[min(wrong)]}")
            if more := faults(a, b, params, given.get("guide_j"), given.get("track"), given.get("gap_track")):
                raise ValueError(f"pair {batch.column(0)[min(more)].as_py()}: {more[min(more)]}")
            found = solve_arrays(range(len(a)), a, b, params, problem, given.get("guide_j"), given.get("track"), given.get("gap_track"), False, True, True)
            if late := found.get("refused"):
                raise ValueError(f"pair {batch.column(0)[min(late)].as_py()}: {late[min(late)]}")
            sums, n, total = sums + found["grad"], n + len(a), total + float(found["score"].sum())
        at = np.flatnonzero(sums)
        cols = [pa.array([n, *[0] * len(at)]), pa.array([total, *[0.0] * len(at)]), pa.array([None, *at.tolist()], pa.int32()), pa.array([None, *sums[at].tolist()], pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, names=["n", "total", "field", "value"])

    rows = src.mapInArrow(run, "n long, total double, field int, value double")
    return rows.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("value").alias("value")).select("n", "total", "field", "value")


def score_distinct(pairs: DataFrame, params: AlignParams, problem: Problem = Problem(), id_col: str = "pair_id") -> DataFrame:
    """(id, score) with each distinct pair of sequences aligned once; equal sequences are common in joined pairs.

    Distinct pairs are found and joined back by a hash of 128 bits, so that no letters are shuffled for the join.
    """
    key = F.struct(F.xxhash64("seq_a", "seq_b").alias("x"), F.xxhash64(F.lit(1), F.reverse("seq_b"), "seq_a").alias("y"))
    once = pairs.groupBy(key.alias("key")).agg(F.first("seq_a").alias("seq_a"), F.first("seq_b").alias("seq_b"))
    scored = align(once, params, replace(problem, grad="none"), id_col="key")
    return pairs.select(id_col, key.alias("key")).join(scored, "key").select(id_col, "score")


def edits_along(found: DataFrame, *keep: str) -> DataFrame:
    """(keep ..., edits): the columns of each path (ops, start_i, start_j) in which seq_a and seq_b do not have the same letter."""
    src = found.select(*keep, "seq_a", "seq_b", "ops", "start_i", "start_j")
    names = [*keep, "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ops, i, j = (batch.column(len(keep) + k) for k in range(5))
            count = []
            for k in range(len(batch)):
                x, y = (np.frombuffer(s[k].as_py().encode("utf-32-le"), np.uint32) for s in (a, b))
                runs = ops[k].values
                moves = np.repeat(runs.field("op").to_numpy(zero_copy_only=False), runs.field("len").to_numpy(zero_copy_only=False))
                at_x, at_y, aligned = i[k].as_py() + np.cumsum(moves != 2) - 1, j[k].as_py() + np.cumsum(moves != 1) - 1, moves == 0
                count.append(len(moves) - int((x[at_x[aligned]] == y[at_y[aligned]]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(count, pa.int64())], names=names)

    return src.mapInArrow(run, ", ".join([*(f"{c} {src.schema[c].dataType.simpleString()}" for c in keep), "edits long"]))
