"""Dynamic programs over a block of sequence pairs, one anti-diagonal at a time.

A block holds pairs of similar lengths, padded.  Every cell of an
anti-diagonal depends on the two before it only, so numpy fills one diagonal of
all pairs at once, with the operands of each cell in their textbook order.
States: linear gaps have one (H), affine gaps three (M aligned, X gap in B,
Y gap in A).  The same recurrence serves the best path (max, +) and the ensemble
of all paths: in probabilities (+, *) while no sum can leave the range of a
double; beyond, in probabilities whose diagonals are rescaled by powers of two
as they go, with a bound on what underflow may have lost; or in logarithms
(logaddexp, +).

Arrays have a row for each row of the table and a column for each pair, so what
a diagonal touches is one contiguous piece.  With a band, only the rows that
some pair's band has on a diagonal are filled.

Memory: three diagonals that take turns, unless a backward pass needs them; of
long pairs only every C-th diagonal is kept, the others are filled again block
by block on the way back.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np

NEG = -np.inf
#: Bytes of tables that a block keeps before it turns to checkpoints.
TABLE_BYTES = 64 << 20

MODES = ("global", "local", "glocal")
MODELS = ("linear", "affine")


@dataclass
class Scoring:
    """Parameters ready for a kernel: flat matrices (K * N * N) and gaps (K, 4) in one precision."""

    matrices: np.ndarray
    gaps: np.ndarray
    n: int
    mode: str
    model: str

    @property
    def fields(self) -> int:
        return self.n * self.n + 4


@dataclass(frozen=True)
class Algebra:
    """How paths add up (plus) and how steps of a path do (times); ``enter`` takes a score into it."""

    plus: object
    times: object
    zero: float
    one: float
    enter: object


BEST = Algebra(np.maximum, np.add, NEG, 0.0, lambda x: x)
LOGS = Algebra(np.logaddexp, np.add, NEG, 0.0, lambda x: x)
PROBABILITIES = Algebra(np.add, np.multiply, 0.0, 1.0, np.exp)
#: Largest exponent for which sums and products of probabilities stay far within a double.
SAFE_EXPONENT = 600.0
LN2 = float(np.log(2))
#: Operations on a cell's state in which a rescaled sum may underflow, at most.
CELL_STEPS = 16
#: Of each width of rescaled sums: the largest step, the growth between two rescalings (both natural logarithms), and the
#: share of all paths that underflow may lose.
RESCALED = {"float32": (70.0, 20.0, 2.0**-20), "float64": (690.0, 150.0, 2.0**-45)}


@dataclass
class Block:
    """Padded codes of pairs (a column each), their lengths, and per-row sets and bands."""

    a: np.ndarray
    b: np.ndarray
    m: np.ndarray
    n: np.ndarray
    track: np.ndarray | None = None
    gap_track: np.ndarray | None = None
    low: np.ndarray | None = None  # (rows, pairs): first and last column of the band
    high: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.m)


def pad(rows: list[np.ndarray], width: int, dtype) -> np.ndarray:
    """One column for each of ``rows``, zeros below."""
    out = np.zeros((len(rows), width), dtype)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out[np.arange(width)[None, :] < size[:, None]] = np.concatenate(rows)
    return np.ascontiguousarray(out.T)


def band_columns(guides: list[np.ndarray], n: np.ndarray, width: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last column of every row's band around a guide (rows beyond a pair repeat its last)."""
    rows = max(map(len, guides))
    low, high = np.zeros((rows, len(guides)), np.int64), np.zeros((rows, len(guides)), np.int64)
    for k, g in enumerate(guides):
        top = int(n[k])
        w = min(width, top)
        hi = g + w
        hi[:-1] = np.maximum(hi[:-1], g[1:] - 1 + w)
        hi = np.minimum(hi, top)
        if mode == "global":
            hi[-1] = top
        low[: len(g), k], high[: len(g), k] = np.maximum(g - w, 0), hi
        low[len(g) :, k], high[len(g) :, k] = low[len(g) - 1, k], hi[-1]
    return low, high


def default_guide(m: int, n: int) -> np.ndarray:
    """The main diagonal, halves rounded up."""
    return np.floor(np.arange(m + 1) * n / m + 0.5).astype(np.int64) if m else np.zeros(1, np.int64)


class Sweep:
    """Fills diagonals of a block, forwards."""

    def __init__(self, block: Block, s: Scoring, algebra: Algebra):
        self.k, self.s, self.algebra, self.kind = block, s, algebra, s.matrices.dtype
        self.unit, self.last = algebra.one, None
        self.weights = algebra.enter(s.matrices)
        self.rows, self.cols = block.a.shape[0], block.b.shape[0]
        self.affine, self.states = s.model == "affine", 3 if s.model == "affine" else 1
        p, g, kind = len(block), s.gaps, s.matrices.dtype
        if block.track is None:
            by_row = by_gap = np.zeros((self.rows + 1, 1), np.int64)
            self.base = block.a.astype(np.int64) * s.n
        else:
            by_row = np.concatenate([block.track[:1] if self.rows else np.zeros((1, p), np.int64), block.track])
            by_gap = block.gap_track
            self.base = (block.track * s.n + block.a) * s.n
        self.open_a, self.ext_a = g[by_gap, 0], g[by_gap, 1]
        self.open_b, self.ext_b = g[by_row, 2], g[by_row, 3]
        self.go_a, self.on_a, self.go_b, self.on_b = (algebra.enter(-x) for x in (self.open_a, self.ext_a, self.open_b, self.ext_b))
        self.b_back = block.b[::-1].astype(np.int64)
        self.column0 = self._column0(kind)
        self.reach = None
        d = np.arange(self.rows + self.cols + 4)
        lo, hi = np.maximum(1, d - self.cols), np.minimum(self.rows, d - 1) + 1
        if block.low is not None:  # rows of column 0 and columns of row 0 that a band leaves
            guide_top = block.low[1:] == 0
            self.reach = (np.cumprod(guide_top, axis=0).sum(axis=0), block.high[0])
            rows = np.arange(self.rows + 1)  # a row's cells lie on the diagonals first to last
            first, last = rows + block.low.min(axis=1), rows + block.high.max(axis=1)
            lo, hi = np.maximum(lo, np.searchsorted(last, d)), np.minimum(hi, np.searchsorted(first, d, side="right"))
        #: Whether some pair's band is narrower than the rows that are filled.
        self.uneven = block.low is not None and bool((block.low != block.low[:, :1]).any() or (block.high != block.high[:, :1]).any())
        self.lo, self.hi = lo.tolist(), np.maximum(lo, hi).tolist()
        self.index, self.found = np.empty((self.rows + 1, p), np.int64), np.empty((self.rows + 1, p), kind)
        self.spare = np.empty((self.rows + 1, p), kind)

    def _column0(self, kind) -> np.ndarray:
        """Scores down column 0: gaps in B from the start.  Runs of equal extends are multiplied, not added up."""
        ext = self.ext_b
        out = np.zeros(ext.shape, kind)
        if not self.rows:
            return out
        p = ext.shape[1]
        start, total, first = np.ones(p, np.int64), np.zeros(p, kind), np.ones(p, bool)
        for i in range(1, self.rows + 1):
            if i > 1:
                turn = ext[i] != ext[i - 1]
                closed = np.where(first, np.asarray(i - 1, kind) * ext[i - 1], total + (i - start).astype(kind) * ext[i - 1])
                total, start, first = np.where(turn, closed, total), np.where(turn, i, start), first & ~turn
            run = np.where(first, np.asarray(i, kind) * ext[i], total + (i - start + 1).astype(kind) * ext[i])
            out[i] = -(self.open_b[1] + run) if self.affine else -run
        return out

    def blank(self) -> list[np.ndarray]:
        return [np.full((self.rows + 1, len(self.k)), self.algebra.zero, self.kind) for _ in range(self.states)]

    def inner(self, d: int) -> tuple[int, int]:
        """Rows of diagonal d away from both borders and within some band, end exclusive."""
        return self.lo[d], self.hi[d]

    def score(self, d: int, lo: int, hi: int) -> np.ndarray:
        """Substitution scores (entered into the algebra) of the cells (i, d - i), lo <= i < hi; overwritten by the next call."""
        at = self.cols - d
        index = np.add(self.base[lo - 1 : hi - 1], self.b_back[at + lo : at + hi], out=self.index[lo:hi])
        return np.take(self.weights, index, out=self.found[lo:hi], mode="clip")

    def outside(self, d: int, lo: int, hi: int) -> np.ndarray | None:
        if not self.uneven:
            return None
        j = d - np.arange(lo, hi)[:, None]
        return (j < self.k.low[lo:hi]) | (j > self.k.high[lo:hi])

    def fill(self, d: int, one: list[np.ndarray], two: list[np.ndarray], out: list[np.ndarray]) -> list[np.ndarray]:
        """Diagonal d from d - 1 and d - 2, written into ``out``, of which a used diagonal's cells may be left out of reach."""
        mode, plus, times, one_, zero = self.s.mode, self.algebra.plus, self.algebra.times, self.unit, self.algebra.zero
        lo, hi = self.inner(d)
        for o in out:  # the range moves by a row at most: no other cell is read
            o[max(lo - 2, 0) : lo] = zero
            o[hi : hi + 2] = zero
        if lo < hi:
            up, here, spare = slice(lo - 1, hi - 1), slice(lo, hi), self.spare[lo:hi]
            score = self.score(d, lo, hi)
            if self.affine:
                m1, x1, y1 = one
                m, x, y = (o[here] for o in out)
                plus(two[0][up], two[1][up], out=m)
                plus(m, two[2][up], out=m)
                times(m, score, out=m)
                for gap, opens, runs, from_, go, on in ((x, (m1, y1), x1, up, self.go_b, self.on_b), (y, (m1, x1), y1, here, self.go_a, self.on_a)):
                    plus(opens[0][from_], opens[1][from_], out=spare)
                    times(spare, go[here], out=spare)
                    times(spare, on[here], out=spare)
                    times(runs[from_], on[here], out=gap)
                    plus(spare, gap, out=gap)
            else:
                (m,) = (o[here] for o in out)
                times(two[0][up], score, out=m)
                for from_, on in ((up, self.on_b), (here, self.on_a)):
                    times(one[0][from_], on[here], out=spare)
                    plus(m, spare, out=m)
            if mode == "local":
                plus(m, one_, out=m)
            outside = self.outside(d, lo, hi)
            if outside is not None:
                for o in out:
                    o[here][outside] = zero
        if d <= self.cols:  # row 0
            for o in out:
                o[0] = zero
            if mode != "global" or d == 0:
                out[0][0] = one_
            else:
                v = self.border(-(self.open_a[0] + d * self.ext_a[0]) if self.affine else -d * self.ext_a[0])
                out[-1][0] = v if self.reach is None else np.where(d <= self.reach[1], v, zero)
        if 0 < d <= self.rows:  # column 0
            for o in out:
                o[d] = zero
            if mode == "local":
                out[0][d] = one_
            else:
                v = self.border(self.column0[d])
                out[1 if self.affine else 0][d] = v if self.reach is None else np.where(d <= self.reach[0], v, zero)
        return out

    def border(self, x: np.ndarray) -> np.ndarray:
        """A score that a border cell has from the start, in the algebra."""
        return self.algebra.enter(x)

    def settle(self, d: int, now: list[np.ndarray], one: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Diagonals d and d - 1 as the next ones read them."""
        return now, one

    def diagonals(self, start: int = 0, stop: int | None = None, one=None, two=None, keep: bool = False):
        """(d, states) for start <= d < stop; ``one`` and ``two`` are the diagonals before ``start``.

        Without ``keep`` a diagonal's arrays are written over three diagonals later.  ``last`` holds diagonals d and d - 1.
        """
        one, two = one or self.blank(), two or self.blank()
        free = None if keep else [self.blank() for _ in range(3)]
        for d in range(start, self.rows + self.cols + 1 if stop is None else stop):
            now, one = self.settle(d, self.fill(d, one, two, self.blank() if keep else free[d % 3]), one)
            self.last = (now, one)
            yield d, now
            one, two = now, one


class Rescaled(Sweep):
    """Sums of probabilities, every few diagonals multiplied by a power of two for each pair, so that their largest is about 1.

    What is stored is the sum over 2 ** ``exponent``; ``exponents`` has those of every diagonal so far.
    """

    def __init__(self, block: Block, s: Scoring, kind: str):
        super().__init__(block, s, PROBABILITIES)
        self.kind, p = np.dtype(kind), len(block)
        largest, growth, self.tolerance = RESCALED[kind]
        self.every = max(1, int(growth / (step_bound(s) + np.log(6))))
        self.weights, self.go_a, self.on_a, self.go_b, self.on_b = (x.astype(self.kind) for x in (self.weights, self.go_a, self.on_a, self.go_b, self.on_b))
        self.found, self.spare = np.empty((self.rows + 1, p), self.kind), np.empty((self.rows + 1, p), self.kind)
        self.exponents = np.zeros((self.rows + self.cols + 2, p))
        self.turn_to(np.zeros(p))

    def turn_to(self, exponent: np.ndarray) -> None:
        self.exponent, self.unit = exponent, np.exp2(-exponent)

    def border(self, x):
        return np.exp(x - self.exponent * LN2)

    def live(self, d: int) -> np.ndarray:
        """Which rows of diagonal d are cells of each pair's own table and band."""
        i = np.arange(self.rows + 1)[:, None]
        j = d - i
        ok = (j >= 0) & (j <= self.k.n) & (i <= self.k.m)
        return ok if self.k.low is None else ok & (j >= self.k.low) & (j <= self.k.high)

    def largest(self, d: int, v: list[np.ndarray]) -> np.ndarray:
        ok = self.live(d)
        return np.max([np.where(ok, x, 0).max(axis=0) for x in v], axis=0).astype(np.float64)

    def shift(self, top: np.ndarray) -> np.ndarray:
        """The power of two that ``top`` is nearest above, 0 of nothing."""
        return np.clip(np.where((top > 0) & np.isfinite(top), np.frexp(top)[1] - 1.0, 0.0), -120 if self.kind == np.float32 else -1000, 1000)

    def settle(self, d, now, one):
        if d % self.every == 0:
            by = self.shift(np.maximum(self.largest(d, now), self.largest(d - 1, one)))
            if by.any():
                self.turn_to(self.exponent + by)
                factor = np.exp2(-by).astype(self.kind)
                now, one = [x * factor for x in now], [x * factor for x in one]
        self.exponents[d] = self.exponent
        return now, one

    def lost(self, log_z: np.ndarray, forward: np.ndarray | None, back: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A bound on the share of all paths that underflow lost, of the total and, given ``forward``, of any part.

        ``forward`` and ``back`` are the largest sums of each diagonal into and out of its cells, these in units of
        2 ** ``before``; ``after`` has the units after rescaling.  A lost term is below the least normal number of its
        units, may still be multiplied by two steps, and counts as often as paths lead on from its cell.
        """
        d = len(back)
        e = self.exponents[:d]
        neighbour = np.maximum(np.maximum(e, np.concatenate([e[:1], e[:-1]])), np.concatenate([e[1:], e[-1:]]))
        tiny = np.log2(float(np.finfo(self.kind).tiny)) + np.log2((self.rows + 1) * self.states * CELL_STEPS) + 2 * step_bound(self.s) / LN2
        least = np.exp2(tiny)
        share = np.exp2(tiny + neighbour + before - log_z / LN2 + np.log2(back + least))
        if forward is not None:
            units = np.maximum(np.maximum(before, after), np.concatenate([after[:1], after[:-1]]))
            share = share + np.exp2(tiny + units + e - log_z / LN2 + np.log2(forward + least)) + np.exp2(tiny + e + before - log_z / LN2)
        return share.sum(axis=0)


def best_state(v: list[np.ndarray]) -> np.ndarray:
    """Which state is the best: M before X before Y."""
    if len(v) == 1:
        return np.zeros(v[0].shape, np.uint8)
    m, x, y = v
    out = (x < y).view(np.uint8) + np.uint8(1)
    out *= ((m < x) | (m < y)).view(np.uint8)
    return out


class Ends:
    """Where the best alignments of a block end, gathered diagonal by diagonal."""

    def __init__(self, sweep: Sweep, places: bool = True):
        self.w, self.places, k = sweep, places, sweep.k
        p = len(k)
        self.score, self.i, self.j, self.state = np.full(p, NEG, sweep.s.matrices.dtype), np.zeros(p, np.int64), np.zeros(p, np.int64), np.zeros(p, np.int8)
        self.mode, self.shortest = sweep.s.mode, int(k.n.min())
        if self.mode == "local":
            self.row = np.full((sweep.rows + 1, p), NEG, self.score.dtype)
            self.col, self.row_state = np.zeros((sweep.rows + 1, p), np.int32), np.zeros((sweep.rows + 1, p), np.int8)

    def see(self, d: int, v: list[np.ndarray]) -> None:
        k = self.w.k
        if self.mode == "local":
            lo, hi = self.w.inner(d)
            if lo >= hi:
                return
            part = [x[lo:hi] for x in v]
            top = part[0]
            if len(part) == 3:
                top = np.maximum(np.maximum(part[0], part[1], out=self.w.spare[lo:hi]), part[2], out=self.w.spare[lo:hi])
            j = d - np.arange(lo, hi)[:, None]
            short = d - lo > self.shortest  # some cells lie beyond a shorter second sequence
            if not self.places:
                row = self.row[lo:hi]
                np.maximum(row, np.where(j <= k.n, top, NEG) if short else top, out=row)
                return
            better = top > self.row[lo:hi]
            if short:
                better &= j <= k.n
            at = np.nonzero(better)
            self.row[lo:hi][at] = top[at]
            self.col[lo:hi][at] = d - lo - at[0]
            if len(part) == 3:
                self.row_state[lo:hi][at] = best_state([x[at] for x in part])
            return
        if self.mode == "global":
            at = np.flatnonzero(k.m + k.n == d)
        else:
            j = d - k.m
            at = (j >= 0) & (j <= k.n)
            if k.low is not None:
                pairs = np.arange(len(k))
                at &= (j >= k.low[k.m, pairs]) & (j <= k.high[k.m, pairs])
            at = np.flatnonzero(at)
        if not len(at):
            return
        ends = [x[k.m[at], at] for x in v]
        top = ends[0] if len(ends) == 1 else np.maximum(np.maximum(ends[0], ends[1]), ends[2])
        if self.mode == "glocal":  # the first of equal columns
            unset = (self.score[at] == NEG) & (self.i[at] == 0) & (self.j[at] == 0)
            better = (top > self.score[at]) | (unset & (top == NEG))
            at, top, ends = at[better], top[better], [e[better] for e in ends]
        self.score[at], self.i[at], self.j[at], self.state[at] = top, k.m[at], d - k.m[at], best_state(ends)

    def done(self) -> Ends:
        if self.mode == "local":
            self.row[np.arange(self.w.rows + 1)[:, None] > self.w.k.m] = NEG
            at = np.arange(len(self.score))
            i = self.row.argmax(axis=0)  # the first row that holds the maximum
            found = self.row[i, at] > 0
            self.score = np.where(found, self.row[i, at], 0).astype(self.score.dtype)
            self.i, self.j = np.where(found, i, 0), np.where(found, self.col[i, at], 0)
            self.state = np.where(found, self.row_state[i, at], 0).astype(np.int8)
        return self


def codes(sweep: Sweep, d: int, now, one, two) -> np.ndarray:
    """Where each cell of diagonal d came from: linear 0 diagonal, 1 up, 2 left; affine the
    predecessors of M, X and Y in two bits each; 3 where a local alignment starts."""
    lo, hi = sweep.inner(d)
    out = np.full((sweep.rows + 1, len(sweep.k)), 3, np.uint8)
    if lo >= hi:
        return out
    up, here, local = slice(lo - 1, hi - 1), slice(lo, hi), sweep.s.mode == "local"
    if not sweep.affine:
        h = now[0][here]
        code = np.where(h == two[0][up] + sweep.score(d, lo, hi), 0, np.where(h == one[0][up] - sweep.ext_b[here], 1, 2)).astype(np.uint8)
        out[here] = np.where(h <= 0, 3, code) if local else code
        return out
    m = best_state([x[up] for x in two])
    ob, eb, oa, ea = sweep.open_b[here], sweep.ext_b[here], sweep.open_a[here], sweep.ext_a[here]
    x = best_state([one[0][up] - ob - eb, one[1][up] - eb, one[2][up] - ob - eb])
    y = best_state([one[0][here] - oa - ea, one[1][here] - oa - ea, one[2][here] - ea])
    if local:
        m[now[0][here] <= 0] = 3
    out[here] = m | (x << 2) | (y << 4)
    return out


def viterbi(block: Block, s: Scoring, paths: bool) -> tuple[Ends, np.ndarray | None, np.ndarray | None]:
    """(ends, moves, counts): the best scores; with ``paths`` also each pair's moves in forward
    order (0 both advance, 1 gap in B, 2 gap in A) in its row's first ``counts`` entries."""
    sweep = Sweep(block, s, BEST)
    ends, total = Ends(sweep, paths), sweep.rows + sweep.cols + 1
    if not paths:
        for d, v in sweep.diagonals():
            ends.see(d, v)
        return ends.done(), None, None
    cell = len(block) * (sweep.rows + 1)
    step = total if total * cell <= TABLE_BYTES else max(2, int(np.sqrt(total * 2 * sweep.states * 8)))
    marks, kept, one, two = {}, {}, sweep.blank(), sweep.blank()
    for d, v in sweep.diagonals():
        if d % step == 0:
            marks[d] = ([x.copy() for x in one], [x.copy() for x in two])
        if step == total:
            kept[d] = codes(sweep, d, v, one, two)
        ends.see(d, v)
        one, two = v, one
    ends.done()
    i, j, state = ends.i.copy(), ends.j.copy(), ends.state.copy()
    moves, count, live = np.zeros((len(block), total), np.uint8), np.zeros(len(block), np.int64), np.ones(len(block), bool)
    for start in sorted(marks, reverse=True):
        if step != total:
            one, two = marks[start]
            kept = {}
            for d, v in sweep.diagonals(start, min(start + step, total), one, two):
                kept[d] = codes(sweep, d, v, one, two)
                one, two = v, one
        for d in range(min(start + step, total) - 1, start - 1, -1):
            p = np.flatnonzero(live & (i + j == d))
            if not len(p):
                continue
            ip, jp = i[p], j[p]
            code, st = kept[d][ip, p], state[p]
            if s.mode == "local":
                stop = (ip == 0) | (jp == 0) if not sweep.affine else ((st == 0) & ((ip == 0) | (jp == 0) | ((code & 3) == 3)))
                if not sweep.affine:
                    stop |= code == 3
            else:
                stop = (ip == 0) & (jp == 0) | ((ip == 0) if s.mode == "glocal" else False)
            live[p[stop]] = False
            go = ~stop
            p, ip, jp, code, st = p[go], ip[go], jp[go], code[go], st[go]
            if sweep.affine:
                move = np.where(ip == 0, 2, np.where(jp == 0, 1, st))
                border = (ip == 0) | (jp == 0)
                state[p] = np.where(border, move, (code >> (2 * move).astype(np.uint8)) & 3)
            else:
                move = np.where(ip == 0, 2, np.where(jp == 0, 1, code))
            moves[p, count[p]] = move
            count[p] += 1
            i[p] -= move != 2
            j[p] -= move != 1
    order = count[:, None] - 1 - np.arange(total)[None, :]
    moves = np.take_along_axis(moves, np.maximum(order, 0), axis=1)
    ends.start_i, ends.start_j = i, j
    return ends, moves, count


def path_counts(block: Block, s: Scoring, ends: Ends, moves: np.ndarray, count: np.ndarray, together: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, field, value) of the gradient of the best path: what it counts of each parameter.

    ``together`` sums over all pairs, as of pair 0.
    """
    total = moves.shape[1]
    used = np.arange(total)[None, :] < count[:, None]
    i = ends.start_i[:, None] + np.cumsum((moves != 2) & used, axis=1)  # the cell each move enters
    j = ends.start_j[:, None] + np.cumsum((moves != 1) & used, axis=1)
    pair, at = np.nonzero(used)
    mv, i, j = moves[pair, at], i[pair, at], j[pair, at]
    track = np.zeros(len(pair), np.int64)
    if block.track is not None:
        across = mv == 2
        track[across] = block.gap_track[i[across], pair[across]]
        track[~across] = block.track[i[~across] - 1, pair[~across]]
    base, square = track * s.fields, s.n * s.n
    new_run = (at == 0) | (moves[pair, np.maximum(at - 1, 0)] != mv)
    aligned = mv == 0
    keys = [base[aligned] + block.a[i[aligned] - 1, pair[aligned]].astype(np.int64) * s.n + block.b[j[aligned] - 1, pair[aligned]]]
    owners, values = [pair[aligned]], [np.ones(int(aligned.sum()))]
    for kind, off in ((1, 2), (2, 0)):  # gaps in B, gaps in A
        gap = mv == kind
        keys.append(base[gap] + square + off + 1)
        owners.append(pair[gap])
        values.append(-np.ones(int(gap.sum())))
        if s.model == "affine":
            opens = gap & new_run
            keys.append(base[opens] + square + off)
            owners.append(pair[opens])
            values.append(-np.ones(int(opens.sum())))
    key, value = np.concatenate(keys), np.concatenate(values)
    return _summed(np.zeros_like(key) if together else np.concatenate(owners), key, value, s, 1 if together else len(block))


def _summed(owner: np.ndarray, key: np.ndarray, value: np.ndarray, s: Scoring, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = len(s.gaps) * s.fields
    if pairs * width <= 4 * len(key):  # few fields: a table of all of them is the shorter way; entries of one field have one sign
        full = np.bincount(owner * width + key, weights=value, minlength=pairs * width)
        at = np.flatnonzero(full)
        return at // width, at % width, full[at]
    both, where = np.unique(owner * width + key, return_inverse=True)
    return both // width, both % width, np.bincount(where, weights=value, minlength=len(both))


def runs(moves: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, move, length): the moves of each pair k in runs first[k]:first[k + 1]."""
    pair, at = np.nonzero(np.arange(moves.shape[1])[None, :] < count[:, None])
    mv = moves[pair, at]
    new = np.flatnonzero((at == 0) | np.append(True, mv[1:] != mv[:-1])) if len(mv) else np.zeros(0, np.int64)
    return np.searchsorted(pair[new], np.arange(len(count) + 1)), mv[new], np.diff(np.append(new, len(mv)))


def guides(block: Block, ends: Ends, moves: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The column after each row of each pair's path (entries beyond a pair's last row mean nothing).

    Rows before and after a local path are interpolated from (0, 0) and to (m, n).
    """
    p, rows = len(block), np.arange(block.a.shape[0] + 1)[None, :]
    every = np.arange(p)
    used = np.arange(moves.shape[1])[None, :] < count[:, None]
    i = ends.start_i[:, None] + np.cumsum((moves != 2) & used, axis=1)  # the cell each move enters
    j = ends.start_j[:, None] + np.cumsum((moves != 1) & used, axis=1)
    g = np.zeros((p, rows.size), np.int64)
    g[every, block.m] = block.n
    g[every, ends.i] = ends.j
    pair, at = np.nonzero(used & (moves != 2))
    g[pair, i[pair, at] - 1] = j[pair, at] - (moves[pair, at] == 0)
    s, e, m, n = (x[:, None] for x in (ends.start_i, ends.i, block.m, block.n))
    at_s, at_e = g[every, ends.start_i][:, None], g[every, ends.i][:, None]
    g = np.where((rows > 0) & (rows < s), at_s * rows // np.maximum(s, 1), g)
    return np.where((rows > e) & (rows < m), at_e + (n - at_e) * (rows - e) // np.maximum(m - e, 1), g)


def step_bound(s: Scoring) -> float:
    """No step of a path changes its score by more than this."""
    return max(float(np.abs(s.matrices).max()), float(np.abs(s.gaps[:, [0, 2]]).max() + np.abs(s.gaps[:, [1, 3]]).max()))


def in_range(s: Scoring, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which pairs' sums over all paths stay within a double as plain probabilities; three moves at most lead out of a cell."""
    return (m + n + 2) * (step_bound(s) + np.log(3)) < SAFE_EXPONENT


def forward_backward(block: Block, s: Scoring, gradient: bool, posterior: bool = False, way: str = "plain", bounded: bool = False) -> tuple[np.ndarray, tuple | None, list | None, np.ndarray | None]:
    """(log Z, gradient as (pair, field, value), posterior guides, which pairs are sound) of the ensemble of all paths.

    ``way``: "plain" sums of pairs within :func:`in_range`; "float32" or "float64" for rescaled sums of that width, where
    results of pairs that are not sound mean nothing; "log" for logarithms.  With ``bounded`` rescaled sums are held to the
    bound that gradients and guides need where none is asked for.
    """
    with np.errstate(invalid="ignore", over="ignore", divide="ignore", under="ignore"):
        return _forward_backward(block, s, way, gradient, posterior, bounded)


def _forward_backward(block, s, way, gradient, posterior, bounded=False):
    algebra, scaled = LOGS if way == "log" else PROBABILITIES, way in RESCALED
    sweep = Rescaled(block, s, way) if scaled else Sweep(block, s, algebra)
    plus, times, zero, logs = algebra.plus, algebra.times, algebra.zero, algebra is LOGS
    p, total, mode = len(block), sweep.rows + sweep.cols + 1, s.mode
    rows = np.arange(sweep.rows + 1)
    pairs = np.arange(p)

    def sums(*xs):
        out = xs[0]
        for x in xs[1:]:
            out = plus(out, x)
        return out

    def in_band(d: int, lo: int = 0, hi: int = sweep.rows + 1) -> np.ndarray:
        i = rows[lo:hi, None]
        j = d - i
        ok = (j >= 0) & (j <= block.n) & (i <= block.m)
        return ok if block.low is None else ok & (j >= block.low[lo:hi]) & (j <= block.high[lo:hi])

    def is_end(d: int, band: np.ndarray, r: np.ndarray) -> np.ndarray:
        if mode == "global":
            return band & (r == block.m) & (d == block.m + block.n)
        return band & (r == block.m) if mode == "glocal" else band

    def ending(d: int, v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, sums) of the paths that end on a diagonal."""
        if mode == "local":
            lo, hi = max(0, d - sweep.cols), min(sweep.rows, d) + 1
            return pairs, plus.reduce(np.where(in_band(d, lo, hi), sums(*(x[lo:hi] for x in v)), zero), axis=0)
        j = d - block.m
        at = (j == block.n) if mode == "global" else (j >= 0) & (j <= block.n)
        if block.low is not None:
            at &= (j >= block.low[block.m, pairs]) & (j <= block.high[block.m, pairs])
        at = np.flatnonzero(at)
        return at, sums(*(x[block.m[at], at] for x in v))

    z = np.full(p, NEG if scaled else zero)
    backward = gradient or posterior or bounded and scaled
    per_table = total * p * (sweep.rows + 1) * 8 * sweep.states
    step = total if per_table <= 4 * TABLE_BYTES else max(2, int(np.sqrt(2 * total)))
    marks, kept, one, two = {}, {}, sweep.blank(), sweep.blank()
    for d, v in sweep.diagonals(keep=backward):
        if backward and d % step == 0:
            marks[d] = (one, two)
        if backward and step == total:
            kept[d] = v
        at, ended = ending(d, v)
        if len(at):
            z[at] = np.logaddexp(z[at], np.log(ended.astype(np.float64)) + sweep.exponent[at] * LN2) if scaled else plus(z[at], ended)
        one, two = sweep.last
    log_z = z if logs or scaled else np.log(z)
    if not backward and not scaled:
        return log_z, None, None, None
    if not backward:  # what leads on from each cell, for the bound alone
        marks, step = {0: (one, two)}, total
    n_sets, square = len(s.gaps), s.n * s.n
    grad = np.zeros(p * n_sets * s.fields)
    guide_value, guide_at = np.full((sweep.rows + 1, p), -1.0), np.zeros((sweep.rows + 1, p), np.int64)
    if block.low is not None:
        guide_at[:] = block.low
    owner = pairs * (n_sets * s.fields)

    share = None  # of one path sum in the units of the diagonal at hand
    tops, bottoms, units, unit = np.zeros((total, p)), np.zeros((total, p)), np.zeros((2, total, p)), np.zeros(p)

    def part(x: np.ndarray) -> np.ndarray:
        """The share of all paths."""
        x = np.exp(x - z) if logs else x * share if scaled else x / z
        return np.where(np.isfinite(x), x, 0.0)

    def stored(d: int) -> list[np.ndarray]:
        """Sums of a diagonal before the one at hand, in its units."""
        v = kept.get(d) or sweep.blank()
        if not scaled or d < 0:
            return v
        by = of.get(d, sweep.exponents[d]) - here_unit
        return [x * np.exp2(by).astype(x.dtype) for x in v] if by.any() else v

    def add(where: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        weight = np.where(where, part(weight), 0.0)
        if at.shape[0] == 1:  # one field a pair
            grad[at[0]] += weight.sum(axis=0)
            return
        np.add(grad, np.bincount(np.broadcast_to(at, weight.shape).ravel(), weights=weight.ravel(), minlength=len(grad)), out=grad)

    if block.track is None:
        by_row = by_gap = np.zeros((1, 1), np.int64)
    else:
        by_row = np.concatenate([block.track[:1] if sweep.rows else np.zeros((1, p), np.int64), block.track]) * s.fields
        by_gap = block.gap_track * s.fields
    edge = np.full((1, p), zero, sweep.kind)
    whole = np.full((sweep.rows + 2, p), zero, sweep.kind)  # a row more than the table, where nothing leads on
    enter = np.concatenate([np.broadcast_to(sweep.on_b, (sweep.rows + 1, p)), edge])
    enter_new = np.concatenate([np.broadcast_to(times(sweep.on_b, sweep.go_b), (sweep.rows + 1, p)), edge])
    ob, eb, oa, ea = (np.broadcast_to(x, (sweep.rows + 1, p)) for x in (sweep.go_b, sweep.on_b, sweep.go_a, sweep.on_a))
    after = after2 = [whole] * sweep.states  # what diagonals d + 1 and d + 2 push back
    last_y, of = np.zeros((sweep.rows + 1, p)) if sweep.affine else whole, {}
    min_j, min_i = int(mode == "local"), int(mode != "global")
    largest = lambda xs: (xs[0] if len(xs) == 1 else np.maximum(np.maximum(xs[0], xs[1]), xs[2])).max(axis=0)
    for start in sorted(marks, reverse=True):
        stop = min(start + step, total)
        if step != total:
            one, two = marks[start]
            kept = {start - 1: one, start - 2: two}
            if scaled:
                sweep.turn_to(sweep.exponents[start - 1] if start else np.zeros(p))
                of = {start - 2: sweep.exponent}
            for d, v in sweep.diagonals(start, stop, one, two, keep=True):
                kept[d] = v
        for d in range(stop - 1, start - 1, -1):
            top, low = max(0, d - sweep.cols), min(sweep.rows, d) + 1  # the rows that the diagonal has
            w, below = slice(top, low), slice(top + 1, low + 1)
            r = rows[w, None]
            band, j = in_band(d, top, low), d - r
            if scaled:
                here_unit = sweep.exponents[d]
                share = np.exp((here_unit + unit) * LN2 - log_z)
            end = np.where(is_end(d, band, r), np.exp2(-unit).astype(sweep.kind) if scaled else algebra.one, zero)
            score = np.full((low - top, p), zero, sweep.kind)  # of the move into (i + 1, j + 1)
            lo, hi = sweep.inner(d + 2)
            if lo < hi:
                score[lo - 1 - top : hi - 1 - top] = sweep.score(d + 2, lo, hi)
            diag = plus(times(after2[0][below], score), end)
            if sweep.affine:  # gaps at the penalties of the row that is entered
                x_on, x_open = times(after[1][below], enter[below]), times(after[1][below], enter_new[below])
                y_on = times(after[2][w], ea[w])
                y_open = times(y_on, oa[w])
                b = [sums(diag, x_open, y_open), sums(diag, x_on, y_open), sums(diag, x_open, y_on)]
            else:
                b = [sums(diag, times(after[0][below], enter[below]), times(after[0][w], ea[w]))]
            b = [np.where(band, x, zero) for x in b]
            if scaled:
                bottoms[d], units[0, d] = largest(b), unit
            if backward:
                f, f1, f2 = [x[w] for x in kept[d]], stored(d - 1), stored(d - 2)
                if scaled:
                    tops[d] = largest([np.where(band, x, 0) for x in f])
            lo, hi = sweep.inner(d)
            if gradient and lo < hi:
                here = slice(lo - top, hi - top)
                pred = times(sums(*(x[lo - 1 : hi - 1] for x in f2)), sweep.score(d, lo, hi))
                key = sweep.base[lo - 1 : hi - 1] + sweep.b_back[sweep.cols - d + lo : sweep.cols - d + hi]
                track = 0 if block.track is None else by_row[lo:hi] // s.fields * 4
                add(band[here], owner + key + track, times(pred, b[0][here]))
            if gradient:
                above = lambda x: x[top - 1 : low - 1] if top else np.concatenate([edge, x[: low - 1]])  # noqa: B023, E731
                set_row, set_gap = (by_row, by_gap) if block.track is None else (by_row[w], by_gap[w])
                i_ok, j_ok = r >= 1, j >= min_j
                if sweep.affine:
                    counted = (
                        (i_ok, set_row, 3, times(f[1], b[1])), (j >= 1, set_gap, 1, times(f[2], b[2])),
                        (i_ok & j_ok, set_row, 2, times(times(times(plus(above(f1[0]), above(f1[2])), ob[w]), eb[w]), b[1])),
                        ((r >= min_i) & (j >= 1), set_gap, 0, times(times(times(plus(f1[0][w], f1[1][w]), oa[w]), ea[w]), b[2])),
                    )
                else:
                    counted = ((i_ok & j_ok, set_row, 3, times(times(above(f1[0]), eb[w]), b[0])), ((r >= min_i) & (j >= 1), set_gap, 1, times(times(f1[0][w], ea[w]), b[0])))
                for where, at, gap, weight in counted:
                    add(band & where, owner + at + square + gap, weight)
            if posterior:
                value = part(sums(*(times(x, y) for x, y in zip(f, b, strict=True))))
                value = value - (last_y[w] if sweep.affine else part(times(times(f[0], ea[w]), last_y[w])))
                better = band & (value >= guide_value[w])
                guide_value[w][better], guide_at[w][better] = value[better], np.broadcast_to(j, band.shape)[better]
                if sweep.affine:
                    last_y = np.zeros((sweep.rows + 1, p))
                    last_y[w] = part(times(f[2], b[2]))
            if scaled:
                if d % sweep.every == 0 and (by := sweep.shift(np.maximum(bottoms[d], largest(after)))).any():
                    unit, factor = unit + by, np.exp2(-by).astype(sweep.kind)
                    b, after = [x * factor for x in b], [x * factor for x in after]
                units[1, d] = unit
            after2, after = after, [whole.copy() for _ in b]
            for x, y in zip(after, b, strict=True):
                x[w] = y
            if posterior and not sweep.affine:
                last_y = after[0]
    out = None
    if gradient:
        full = grad.reshape(p, n_sets, s.fields)
        full[:, :, square:] *= -1
        pair, at = np.nonzero(full.reshape(p, -1))
        out = (pair, at, full.reshape(p, -1)[pair, at])
    guides = [np.maximum.accumulate(np.clip(guide_at[: block.m[k] + 1, k], 0, block.n[k])) for k in range(p)] if posterior else None
    sound = np.isfinite(log_z) & (sweep.lost(log_z, tops if backward else None, bottoms, *units) <= sweep.tolerance) if scaled else None
    return log_z, out, guides, sound


def is_unit(s: Scoring) -> bool:
    """Whether scores are edit distances below 0: 0 for equal symbols, -1 for others and for each gap column."""
    return s.mode == "global" and s.model == "linear" and len(s.gaps) == 1 and bool((s.gaps[0, [1, 3]] == 1).all()) and bool((s.matrices.reshape(s.n, s.n) == np.eye(s.n) - 1).all())


class Edits:
    """A rectangle of the table of edit distances, a bit a cell and an integer a column.

    ``down`` has the steps down its column 0 as (rises, falls), a bit a row; ``along`` those along its row 0, one a column
    (-1, 0, 1).  :meth:`fill` leaves ``right`` and ``low``, the same of its last column and row.  Only the columns at every
    ``every``-th place are kept; a path is found in those between, filled once more.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, down: tuple[int, int] | None = None, along: np.ndarray | None = None):
        self.rows, self.cols, self.a, self.b = len(a), len(b), a, b
        self.full = (1 << self.rows) - 1
        self.down = (self.full, 0) if down is None else down
        self.along = np.ones(self.cols, np.int8) if along is None else along
        used = np.unique(np.concatenate([a, b]))
        bits = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
        self.equal = {int(c): bits(a == c) for c in used}
        self.every = max(1, int(np.sqrt(self.cols)))

    def _columns(self, lo: int, hi: int, state: tuple[int, int], kept: list | None = None, low: np.ndarray | None = None) -> tuple[int, int]:
        full, last, rows = self.full, self.rows - 1, self.rows
        rises, falls = state
        for j, (c, step) in enumerate(zip(self.b[lo:hi].tolist(), self.along[lo:hi].tolist(), strict=True)):
            equal = self.equal[c]
            if step < 0:
                equal |= 1
            same = (((equal & rises) + rises) ^ rises) | equal | falls  # where a cell equals the one up and left of it
            same &= full
            up, fall = (falls | (full ^ (same | rises))), rises & same
            if low is not None:
                low[lo + j] = (up >> last & 1) - (fall >> last & 1) if rows else step
            up = (up << 1 | (step > 0)) & full
            fall = (fall << 1 | (step < 0)) & full
            rises, falls = (fall | (full ^ (same | up))), up & same
            if kept is not None:
                kept.append((same, rises))
        return rises, falls

    def fill(self) -> Edits:
        self.low, self.marks, state = np.zeros(self.cols, np.int8), {}, self.down
        for lo in range(0, self.cols, self.every):
            self.marks[lo] = state
            state = self._columns(lo, min(lo + self.every, self.cols), state, low=self.low)
        self.right = state
        return self

    def walk(self, i: int, j: int) -> tuple[int, int, np.ndarray]:
        """Back from a cell to row or column 0: (i, j, moves from the end), ties M before X before Y."""
        moves, size = bytearray(), self.rows + 7 >> 3
        a, b, at = self.a.tolist(), self.b.tolist(), None
        while i and j:
            lo = (j - 1) // self.every * self.every
            if lo != at:
                at, kept = lo, []
                self._columns(lo, min(lo + self.every, self.cols), self.marks[lo], kept)
                kept = [tuple(x.to_bytes(size, "little") for x in pair) for pair in kept]
            same, rises = kept[j - 1 - lo]
            place, bit = (i - 1) >> 3, (i - 1) & 7
            if a[i - 1] == b[j - 1] or not same[place] >> bit & 1:
                move = 0
            else:
                move = 1 if rises[place] >> bit & 1 else 2
            moves.append(move)
            i, j = i - (move != 2), j - (move != 1)
        return i, j, np.frombuffer(bytes(moves), np.uint8)


def edit_path(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """(distance, moves in forward order) of one pair."""
    table = Edits(a, b).fill()
    i, j, moves = table.walk(len(a), len(b))
    moves = np.concatenate([moves, np.ones(i, np.uint8), np.full(j, 2, np.uint8)])[::-1]
    return len(a) + int(table.low.sum(dtype=np.int64)), moves


def edits(block: Block, paths: bool) -> tuple[SimpleNamespace, np.ndarray | None, np.ndarray | None]:
    """What :func:`viterbi` returns, of a block of one pair whose scores are edit distances."""
    a, b = block.a[: block.m[0], 0], block.b[: block.n[0], 0]
    ends = SimpleNamespace(i=block.m, j=block.n, start_i=np.zeros(1, np.int64), start_j=np.zeros(1, np.int64))
    if not paths:
        ends.score = np.array([-float(len(a) + Edits(a, b).fill().low.sum(dtype=np.int64))])
        return ends, None, None
    distance, moves = edit_path(a, b)
    ends.score = np.array([-float(distance)])
    return ends, moves[None, :], np.array([len(moves)])
