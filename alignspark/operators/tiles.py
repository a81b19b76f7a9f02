"""One long pair over many tasks: the table in square tiles, filled wave by wave.

A tile needs the row above it and the column to its left, and leaves its own
last row and last column.  The tiles of one anti-diagonal do not depend on each
other: they are the rows of one frame, and a wave is one job over them.  Each
wave is written to the shared folder with its borders, so nothing of an earlier
wave is computed again, whatever executors are lost, and a task holds one tile
at a time.  Written borders take 6 * (m * n) / tile numbers, not m * n.

Paths are traced back tile by tile: a tile is filled again from its written
borders, with a code a cell, and the walk goes on in the tile that it leaves
to.  All pairs of a frame advance together.

Results equal those of :func:`alignspark.operators.align.align`: values, ends,
and paths with ties M before X before Y.  A linear gap is an affine one that
costs nothing to open.

Tables of edit distances are filled a bit a cell, in larger tiles: borders are
distances, 4 bytes a place, and a path is found from every k-th column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.operators.align import OPS, Problem
from alignspark.params import AlignParams
from alignspark.plans import kernel as kn
from alignspark.sources.storage import discard, materialize

TILE = 4096
#: Tiles along the longest sequence to which tables of edit distances are held, however small a tile is asked for: a wave is a job.
SIDE = 24
_NONE = -np.inf
_WAVE = "pair_id long, p int, q int, m long, n long, a string, b string, top binary, left binary, low binary, right binary, score double, end_i long, end_j long, state int"
_STEP = f"pair_id long, step int, done boolean, p int, q int, i long, j long, state int, runs {OPS}"


class Tile:
    """A rectangle of the table: local row and column 0 are given, the others filled."""

    def __init__(self, a: np.ndarray, b: np.ndarray, matrix: np.ndarray, gaps: np.ndarray, local: bool, top: np.ndarray, left: np.ndarray):
        self.a, self.b, self.local, self.top, self.left = a.astype(np.int64) * matrix.shape[0], b[::-1].astype(np.int64), local, top, left
        self.scores, (self.open_a, self.ext_a, self.open_b, self.ext_b) = matrix.ravel(), gaps
        self.rows, self.cols = len(a), len(b)

    def fill(self, traced: bool = False) -> None:
        """low and right: the last row and column of (M, X, Y); for local alignments the best cell; with ``traced`` the codes."""
        rows, cols = self.rows, self.cols
        self.low, self.right = np.full((3, cols + 1), _NONE), np.full((3, rows + 1), _NONE)
        one, two, now = (np.full((3, rows + 1), _NONE) for _ in range(3))
        if traced:
            self.codes = np.zeros((rows + cols + 1, rows + 1), np.uint8)
        if self.local:
            self.best, self.column, self.kind = np.full(rows + 1, _NONE), np.zeros(rows + 1, np.int64), np.zeros(rows + 1, np.int8)
        for d in range(rows + cols + 1):
            lo, hi = max(1, d - cols), min(rows, d - 1) + 1
            if lo < hi:
                up, here = slice(lo - 1, hi - 1), slice(lo, hi)
                (m1, x1, y1), (m2, x2, y2) = one, two
                m, x, y = (z[here] for z in now)
                np.maximum(np.maximum(m2[up], x2[up], out=m), y2[up], out=m)
                m += self.scores[self.a[up] + self.b[cols - d + lo : cols - d + hi]]
                np.maximum(np.maximum(m1[up], y1[up]) - self.open_b - self.ext_b, x1[up] - self.ext_b, out=x)
                np.maximum(np.maximum(m1[here], x1[here]) - self.open_a - self.ext_a, y1[here] - self.ext_a, out=y)
                if traced:
                    from_m = self._first(m2[up], x2[up], y2[up])
                    if self.local:
                        from_m[m <= 0] = 3
                    from_x = self._first(m1[up] - self.open_b, x1[up], y1[up] - self.open_b)
                    from_y = self._first(m1[here] - self.open_a, x1[here] - self.open_a, y1[here])
                    self.codes[d, here] = from_m | from_x << 2 | from_y << 4
                if self.local:
                    np.maximum(m, 0, out=m)
                    high = np.maximum(np.maximum(m, x), y)
                    better = np.flatnonzero(high > self.best[here])
                    if len(better):
                        at = better + lo
                        self.best[at], self.column[at], self.kind[at] = high[better], d - at, self._first(m[better], x[better], y[better])
            if d <= cols:
                now[:, 0] = self.top[:, d]
            if d <= rows:
                now[:, d] = self.left[:, d]
            if 0 <= d - rows <= cols:
                self.low[:, d - rows] = now[:, rows]
            if 0 <= d - cols <= rows:
                self.right[:, d - cols] = now[:, d - cols]
            one, two, now = now, one, two

    @staticmethod
    def _first(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of three is the best: M before X before Y."""
        return np.where((m >= x) & (m >= y), 0, np.where(x >= y, 1, 2)).astype(np.uint8)

    def walk(self, i: int, j: int, state: int) -> tuple[int, int, int, list[tuple[int, int]], bool]:
        """Back from a cell to local row or column 0, or a local start: (i, j, state, runs from the end, whether it started there)."""
        runs: list[list[int]] = []
        while i and j:
            code = int(self.codes[i + j, i]) >> 2 * state & 3
            if state == 0 and code == 3:
                return i, j, state, [tuple(r) for r in runs], True
            if runs and runs[-1][0] == state:
                runs[-1][1] += 1
            else:
                runs.append([state, 1])
            i, j, state = i - (state != 2), j - (state != 1), code
        return i, j, state, [tuple(r) for r in runs], False


class EditTile:
    """The same of edit distances; borders are the distances at them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray):
        self.rows, self.cols, self.top, self.left = len(a), len(b), top, left
        bits = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
        step = np.diff(left)
        self.table = kn.Edits(a, b, (bits(step > 0), bits(step < 0)), np.diff(top))

    def fill(self, traced: bool = False) -> None:
        self.table.fill()
        rises, falls = (np.unpackbits(np.frombuffer(x.to_bytes(self.rows + 7 >> 3, "little"), np.uint8), count=self.rows, bitorder="little").astype(np.int32) for x in self.table.right)
        self.low = np.cumsum(np.concatenate([self.left[-1:], self.table.low]), dtype=np.int32)
        self.right = np.cumsum(np.concatenate([self.top[-1:], rises - falls]), dtype=np.int32)

    def walk(self, i: int, j: int, state: int) -> tuple[int, int, int, list[tuple[int, int]], bool]:
        i, j, moves = self.table.walk(i, j)
        if not len(moves):
            return i, j, state, [], False
        first = np.flatnonzero(np.append(True, moves[1:] != moves[:-1]))
        return i, j, 0, list(zip(moves[first].tolist(), np.diff(np.append(first, len(moves))).tolist(), strict=True)), False


def _border(mode: str, gap_open: float, extend: float, first: int, size: int, down: bool) -> np.ndarray:
    """(M, X, Y) of row 0 from column ``first``, or of column 0 from row ``first`` (``down``)."""
    out = np.full((3, size + 1), _NONE)
    k = np.arange(first, first + size + 1)
    if mode == "local" or mode == "glocal" and not down:
        out[0] = 0
        return out
    out[1 if down else 2] = -(gap_open + k * extend)
    if first == 0:
        out[:, 0] = 0 if mode != "local" else out[:, 0]
        out[1:, 0] = _NONE
    return out


def _shape(params: AlignParams, problem: Problem) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.array(params.gaps[0], np.float64)
    if problem.gap_model == "linear":
        gaps[[0, 2]] = 0
    return np.asarray(params.matrices[0], np.float64), gaps


def _tile_of(row: dict, params: AlignParams, problem: Problem, tile: int) -> Tile | EditTile:
    matrix, gaps = _shape(params, problem)
    a, b = params.alphabet.codes(row["a"]), params.alphabet.codes(row["b"])
    if kn.is_unit(problem.scoring(params)):
        top = np.arange(row["q"] * tile, row["q"] * tile + len(b) + 1, dtype=np.int32) if row["top"] is None else np.frombuffer(row["top"], np.int32)
        left = np.arange(row["p"] * tile, row["p"] * tile + len(a) + 1, dtype=np.int32) if row["left"] is None else np.frombuffer(row["left"], np.int32)
        return EditTile(a, b, top, left)
    top = _border(problem.mode, gaps[0], gaps[1], row["q"] * tile, len(b), False) if row["top"] is None else np.frombuffer(row["top"]).reshape(3, -1)
    left = _border(problem.mode, gaps[2], gaps[3], row["p"] * tile, len(a), True) if row["left"] is None else np.frombuffer(row["left"]).reshape(3, -1)
    return Tile(a, b, matrix, gaps, problem.mode == "local", top, left)


def _end(t: Tile | EditTile, row: dict, mode: str, tile: int) -> tuple[float | None, int, int, int]:
    """The best end within a tile: (score, i, j, state), the first of equals."""
    i0, j0 = row["p"] * tile, row["q"] * tile
    last = i0 + t.rows == row["m"]
    if mode == "local":
        i = int(t.best.argmax())
        return (float(t.best[i]), i0 + i, j0 + int(t.column[i]), int(t.kind[i])) if t.best[i] > 0 else (None, 0, 0, 0)
    if not last or mode == "global" and j0 + t.cols < row["n"]:
        return None, 0, 0, 0
    if isinstance(t, EditTile):
        return -float(t.low[-1]), i0 + t.rows, j0 + t.cols, 0
    high = t.low.max(axis=0)
    j = int(high.argmax()) if mode == "glocal" else t.cols
    if mode == "glocal" and j == 0 and j0:
        high = high[1:]  # the column before belongs to the tile before
        j = 1 + int(high.argmax())
    return float(t.low[:, j].max()), i0 + t.rows, j0 + j, int(Tile._first(*t.low[:, j : j + 1])[0])


def _filled(ready: DataFrame, params: AlignParams, problem: Problem, tile: int) -> DataFrame:
    names = [x.split()[0] for x in _WAVE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _tile_of(row, params, problem, tile)
                t.fill()
                row["low"], row["right"] = t.low.tobytes(), t.right.tobytes()
                row["score"], row["end_i"], row["end_j"], row["state"] = _end(t, row, problem.mode, tile)
                kinds = {"pair_id": pa.int64(), "p": pa.int32(), "q": pa.int32(), "m": pa.int64(), "n": pa.int64(), "score": pa.float64(), "end_i": pa.int64(), "end_j": pa.int64(), "state": pa.int32(), "a": pa.string(), "b": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.binary())) for c in names], names=names)

    return ready.mapInArrow(run, _WAVE)


def _pieces(pairs: DataFrame, seq: str, number: str, name: str, tile: int) -> DataFrame:
    """(pair_id, number, name): a sequence in pieces of ``tile`` letters; an empty one is one empty piece."""
    last = F.greatest(F.ceil(F.length(seq) / tile).cast("int") - 1, F.lit(0))
    return pairs.select("pair_id", seq, F.explode(F.sequence(F.lit(0), last)).alias(number)).select("pair_id", number, F.substring(seq, F.col(number) * tile + 1, F.lit(tile)).alias(name))


def _tasks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def align_tiled(pairs: DataFrame, params: AlignParams, problem: Problem = Problem(), outputs: tuple[str, ...] = ("score",), tile: int = TILE) -> DataFrame:
    """pair_id, score, and with ``path`` ops, start_i, start_j, end_i, end_j of pairs (pair_id, seq_a, seq_b) too long for one task.

    Wants 64-bit ids and no guides, tracks or ensembles; other pairs belong to
    :func:`align`.  A null sequence or a foreign character fails the job.
    """
    if tile < 1:
        raise ValueError("a tile has one row at least")
    if problem.grad == "soft" or problem.band or params.num_sets > 1:
        raise ValueError("tiles hold best paths of one parameter set, without a band")
    problem.check(params)
    spark = pairs.sparkSession
    long_ids = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "seq_a", "seq_b")
    for c in ("seq_a", "seq_b"):
        long_ids = long_ids.withColumn(c, F.coalesce(c, F.raise_error(F.concat(F.lit("pair "), F.col("pair_id").cast("string"), F.lit(f": {c} is null")))))
    sizes = materialize(long_ids.select("pair_id", F.length("seq_a").cast("long").alias("m"), F.length("seq_b").cast("long").alias("n")), "tiles-sizes")
    if kn.is_unit(problem.scoring(params)):
        longest = sizes.agg(F.max(F.greatest("m", "n"))).first()[0] or 0
        tile = max(tile, -(-longest // SIDE))
    a = materialize(_pieces(long_ids, "seq_a", "p", "a", tile), "tiles-a")
    b = materialize(_pieces(long_ids, "seq_b", "q", "b", tile), "tiles-b")
    nothing = F.lit(None).cast("binary")
    # the tiles of a wave, with the borders that the wave before left
    ready = sizes.select("pair_id", F.lit(0).alias("p"), F.lit(0).alias("q"), "m", "n", nothing.alias("top"), nothing.alias("left"))
    waves: list[DataFrame] = []
    while True:
        rows = ready.join(a, ["pair_id", "p"]).join(b, ["pair_id", "q"]).select("pair_id", "p", "q", "m", "n", "a", "b", "top", "left")
        wave = materialize(_filled(rows.repartition(_tasks(pairs), "pair_id", "p", "q"), params, problem, tile), "tiles-wave")
        if not wave.select("pair_id").limit(1).collect():
            discard(wave)
            break
        waves.append(wave)
        below = wave.select("pair_id", (F.col("p") + 1).alias("p"), "q", "m", "n", F.col("low").alias("top"), nothing.alias("left")).where(F.col("p") * tile < F.col("m"))
        beside = wave.select("pair_id", "p", (F.col("q") + 1).alias("q"), "m", "n", nothing.alias("top"), F.col("right").alias("left")).where(F.col("q") * tile < F.col("n"))
        ready = below.unionByName(beside).groupBy("pair_id", "p", "q", "m", "n").agg(F.first("top", True).alias("top"), F.first("left", True).alias("left"))
    grid = waves[0] if waves else _filled(ready.join(a, ["pair_id", "p"]).join(b, ["pair_id", "q"]).select("pair_id", "p", "q", "m", "n", "a", "b", "top", "left"), params, problem, tile)
    for wave in waves[1:]:
        grid = grid.unionByName(wave)
    # the best end, the first of equals in row order
    best = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("less"), "end_i", "end_j", "state"))).alias("x")
    ends = grid.groupBy("pair_id").agg(best).select("pair_id", F.coalesce(-F.col("x.less"), F.lit(0.0)).alias("score"), *(F.coalesce(f"x.{c}", F.lit(0)).cast("int").alias(c) for c in ("end_i", "end_j", "state")), F.col("x").isNull().alias("none"))
    ends = materialize(ends, "tiles-ends")
    written = [a, b, sizes, *waves]
    if "path" in outputs:
        ends = _traced(ends, grid, params, problem, tile)
    else:
        ends = ends.select("pair_id", "score")
    for w in written:
        discard(w)
    return ends


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (the second column) of which neighbours of one move are joined."""
    for batch in batches:
        lists, rows = batch.column(1), []
        for k in range(len(batch)):
            op, size = (lists[k].values.field(c).to_numpy(zero_copy_only=False) for c in ("op", "len"))
            first = np.flatnonzero(np.append(True, op[1:] != op[:-1])) if len(op) else np.zeros(0, np.int64)
            rows.append((op[first], np.add.reduceat(size, first) if len(op) else size))
        edges = np.concatenate([[0], np.cumsum([len(op) for op, _ in rows])]).astype(np.int32)
        op, size = (np.concatenate([np.zeros(0, kind), *x]).astype(kind) for kind, x in zip((np.int8, np.int32), zip(*rows), strict=True)) if rows else (np.zeros(0, np.int8), np.zeros(0, np.int32))
        joined = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(op), pa.array(size)], ["op", "len"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), joined, batch.column(2), batch.column(3)], names=["pair_id", "ops", "start_i", "start_j"])


def _traced(ends: DataFrame, grid: DataFrame, params: AlignParams, problem: Problem, tile: int) -> DataFrame:
    """Paths back from the ends, a tile of each pair a round."""
    mode = problem.mode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _tile_of(row, params, problem, tile)
                t.fill(traced=True)
                p, q = row["p"], row["q"]
                i, j, state, runs, started = t.walk(row["i"] - p * tile, row["j"] - q * tile, row["at_state"])
                i, j = i + p * tile, j + q * tile
                done = started or i == 0 or j == 0
                if not started and mode != "local":  # what is left along a border is one gap
                    if j == 0 and i:
                        runs, i = [*runs, (1, i)], 0
                    elif i == 0 and j and mode == "global":
                        runs, j = [*runs, (2, j)], 0
                found = pa.array([[{"op": o, "len": k} for o, k in runs]], pa.list_(pa.struct([("op", pa.int8()), ("len", pa.int32())])))
                to = (-(-i // tile) - 1, -(-j // tile) - 1)
                cols = [pa.array([row["pair_id"]], pa.int64()), pa.array([row["step"] + 1], pa.int32()), pa.array([done]), *(pa.array([max(x, 0)], pa.int32()) for x in to), pa.array([i], pa.int64()), pa.array([j], pa.int64()), pa.array([state], pa.int32()), found]
                yield pa.RecordBatch.from_arrays(cols, names=["pair_id", "step", "done", "p", "q", "i", "j", "state", "runs"])

    last = lambda c: F.greatest(F.ceil(F.col(c) / tile).cast("int") - 1, F.lit(0))
    at = ends.where(~F.col("none")).select("pair_id", F.lit(0).alias("step"), last("end_i").alias("p"), last("end_j").alias("q"), F.col("end_i").cast("long").alias("i"), F.col("end_j").cast("long").alias("j"), F.col("state").alias("at_state"))
    steps: list[DataFrame] = []
    tiles = grid.select("pair_id", "p", "q", "a", "b", "top", "left")
    while True:
        rows = at.join(tiles, ["pair_id", "p", "q"]).repartition(_tasks(ends), "pair_id")
        step = materialize(rows.mapInArrow(run, _STEP), "tiles-step")
        steps.append(step)
        at = step.where(~F.col("done")).select("pair_id", "step", "p", "q", "i", "j", F.col("state").alias("at_state"))
        if not at.limit(1).collect():
            break
    walked = steps[0]
    for s in steps[1:]:
        walked = walked.unionByName(s)
    # a pair's runs from its start; where a tile ends within a run, its two parts are one
    last_first = F.reverse(F.array_sort(F.collect_list(F.struct("step", F.reverse("runs").alias("runs"), "i", "j"))))
    each = walked.groupBy("pair_id").agg(last_first.alias("parts"))
    flat = F.flatten(F.transform("parts", lambda x: x["runs"]))
    each = each.select("pair_id", flat.alias("flat"), F.col("parts")[0]["i"].cast("int").alias("start_i"), F.col("parts")[0]["j"].cast("int").alias("start_j"))
    paths = each.mapInArrow(_whole_runs, f"pair_id long, ops {OPS}, start_i int, start_j int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = ends.join(paths, "pair_id", "left").select("pair_id", "score", F.coalesce("ops", F.array().cast(OPS)).alias("ops"), zero("start_i"), zero("start_j"), "end_i", "end_j")
    out = materialize(out, "tiles-paths")
    for s in steps:
        discard(s)
    return out
