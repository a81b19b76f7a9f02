"""Every sequence of one list against every one of another, in the narrowest integers that hold the scores.

All sequences of a list have one length, so nothing is padded, and a diagonal of
all pairs is a few passes over small integers: substitution scores of a whole
second list are rows of a profile, and scores are kept with the extends of all
their cells added back, so that a running gap costs nothing.  Parameters are
integral, gap costs not negative, and there is one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from alignspark.plans.kernel import Scoring, band_columns, best_state, default_guide

#: Bytes that the diagonals' rows have for the pairs that are filled at once; with paths, the bytes of their tables.
BYTES, PATH_BYTES = 1 << 19, 1 << 26
#: Lists of so many sequences are filled row by row, so many of them at once.
LONG, WIDE = 512, 1536
#: Letters of a gap along a row that rows look at; scores that could pay for a longer one are filled again.
REACH = 4


def _top(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The largest of each column, by halves (a reduction over rows would go through them one by one)."""
    k = len(x)
    while k > 1:
        half = (k + 1) // 2
        np.maximum(x[: k - half], x[half:k], out=spare[: k - half])
        spare[k - half : half] = x[k - half : half]
        x, k = spare, half
    return x[0]


class Crossed:
    """Sequences of m letters against sequences of n (codes, a row each); with ``band`` scores within so many columns of the main diagonal."""

    def __init__(self, s: Scoring, m: int, n: int, band: int = 0):
        flat = np.concatenate([s.matrices, s.gaps.ravel()]).astype(np.float64)
        if len(s.gaps) != 1 or (flat != np.rint(flat)).any() or s.gaps.min() < 0:
            raise ValueError("crossed lists need one set of integral parameters and no negative gap cost")
        flat = flat.astype(np.int64)
        #: What scores are multiples of.
        self.unit = max(1, int(np.gcd.reduce(flat)))
        flat //= self.unit
        self.s, self.m, self.n, self.size = s, m, n, s.n
        oa, ea, ob, eb = flat[-4:].tolist()
        if s.model == "linear":
            oa = ob = 0
        self.oa, self.ea, self.ob, self.eb = oa, ea, ob, eb
        weights = flat[: s.n * s.n].reshape(s.n, s.n) + ea + eb
        most = min(m, n) * max(0, int(weights.max()) - ea - eb) + m * eb + n * ea + max(0, int(weights.max()))
        least = -2 * (oa + ob) + min(0, int(weights.min())) - max(oa, ob)
        #: First and last column of each row's band, and what is less than any score of a cell that paths within it reach.
        self.band = self.outside = None
        if band:
            low, high = band_columns([default_guide(m, n)], np.array([n]), band, s.mode)
            self.band = low[:, 0], high[:, 0]
            steps = m + n + 2
            fall = steps * (oa + ob + max(0, -int(weights.min())))
            self.outside = -fall - steps * max(0, int(weights.max())) - 1
            #: What no score exceeds, and the least less that; the columns on either side.
            self.cap, self.width = most + 1, min(band, n)
            least = self.outside - max(fall + m * eb + n * ea, self.cap)
        self.kind = next(np.dtype(k) for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min < least - 1 and most < np.iinfo(k).max)
        self.tables = None  # of paths, used again
        self.low, self.weights = np.iinfo(self.kind).min, weights.astype(self.kind)

    def added(self, i, j):
        """The extends that are added back at a cell."""
        return i * self.eb + j * self.ea

    def profile(self, b: np.ndarray) -> np.ndarray:
        """Substitution scores: row c * n + j has letter c against the j-th letters of all of ``b``."""
        return np.ascontiguousarray(self.weights[:, b.T]).reshape(self.size * self.n, len(b))

    def blocks(self, a: np.ndarray, b: np.ndarray, width: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Parts of the two lists that make up to ``width`` pairs (one at least), with the profile of the second."""
        width = max(1, width)
        for y in range(0, len(b), width):
            right = b[y : y + width]
            profile, step = self.profile(right), max(1, width // len(right))
            for x in range(0, len(a), step):
                yield slice(x, x + step), slice(y, y + width), profile

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The best score of every pair, a row for each of ``a``."""
        out = np.empty((len(a), len(b)), np.int64)
        # An extend has one cost in both, and no two adjacent gaps beat aligning their letters.
        even = self.s.mode == "local" and self.ea == self.eb and self.weights.min() >= 0
        if even and self.band is None and min(out.shape) and min(self.m, self.n) and max(out.shape) >= LONG and self._by_rows(a, b, out):
            return out
        for x, y, profile in self.blocks(a, b, BYTES // ((self.m + self.n + 2) * self.kind.itemsize)):
            out[x, y] = self._fill(a[x], profile, profile.shape[1])[0]
        return out

    def scores_around(self, a: np.ndarray, b: np.ndarray, guides: np.ndarray) -> np.ndarray:
        """The best local score of every pair within the band around its guide (:meth:`guides`)."""
        out, n, w = np.empty((len(a), len(b)), np.int64), self.n, self.width
        kind = np.int16 if n + w < np.iinfo(np.int16).max else np.int64
        for x, y, profile in self.blocks(a, b, BYTES // ((self.m + self.n + 2) * self.kind.itemsize)):
            g = guides[:, x, y].astype(kind, order="C").reshape(self.m + 1, -1)
            high = g + w
            high[:-1] = np.maximum(high[:-1], g[1:] - 1 + w)
            limits = np.maximum(g - w, 0), np.minimum(high, n)
            out[x, y] = self._fill(a[x], profile, profile.shape[1], limits=limits)[0]
        return out

    def guides(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The column after each row of every pair's best local path, straight lines before and after it: (rows, a, b)."""
        m, n = self.m, self.n
        kind, rows = np.int16 if 2 * n < np.iinfo(np.int16).max else np.int64, np.arange(m + 1)[:, None]
        out = np.empty((m + 1, len(a), len(b)), kind)
        for x, y, score, ends, one, wide in self._paths(a, b):
            start, end = (np.zeros(score.size, np.int64) for _ in range(2))
            g = np.zeros((m + 1, score.size), kind)
            g[m] = n
            g[0, score.ravel() == 0] = 0
            for k, (p, i, j, state, _) in enumerate(self._steps(self.tables, score.ravel() // self.unit, ends)):
                if not k:  # the last cell of each path
                    end[p], g[i, p] = i, j
                q = np.flatnonzero(state != 2)
                g[i[q] - 1, p[q]] = j[q] - (state[q] == 0)
                start[p] = i - (state != 2)
            every = np.arange(score.size)
            first, last = g[start, every], g[end, every]
            g = np.where((rows > 0) & (rows < start), first * rows // np.maximum(start, 1), g)
            g = np.where((rows > end) & (rows < m), last + (n - last) * (rows - end) // np.maximum(m - end, 1), g)
            out[:, x, y] = g.reshape(m + 1, *score.shape)
        return out

    def _by_rows(self, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> bool:
        """Best local scores into ``out``, but if many pairs could have long gaps."""
        if len(a) > len(b):
            _Rows(self.weights.T, self.ea, self.oa, self.ob).fill(b, a, out.T)
        else:
            _Rows(self.weights, self.ea, self.ob, self.oa).fill(a, b, out)
        if max(self.m, self.n) > REACH:
            x, y = np.nonzero(out > max(0, min(self.oa, self.ob) + (REACH + 1) * self.ea))
            if len(x) * 8 > out.size:
                return False
            width, flat = max(1, BYTES // self.m), self.weights.ravel()
            for k in range(0, len(x), width):
                p, q = x[k : k + width], y[k : k + width]
                # One sequence, whose letters are its places: the profile has those of each pair.
                left, right = a[p].T * np.intp(self.size), np.ascontiguousarray(b[q].T)
                profile = np.empty((self.m, self.n, len(p)), self.kind)
                for i in range(self.m):
                    flat.take(left[i] + right, out=profile[i], mode="clip")
                out[p, q] = self._fill(np.arange(self.m)[None], profile.reshape(-1, len(p)), len(p))[0][0] // self.unit
        out *= self.unit
        return True

    def path_sums(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, pairs, gradients): the gradients of the best paths, summed over all pairs of one score; a row a score."""
        fields, parts = self.s.fields, []
        for _, y, score, ends, one, wide in self._paths(a, b):
            kinds, of_pair = np.unique(score.ravel(), return_inverse=True)
            keys = of_pair.ravel() * fields
            sums = np.zeros((len(kinds), fields))
            for p, field in self._trace(self.tables, score.ravel() // self.unit, ends, np.repeat(one, wide, axis=0).T, np.tile(b[y], (len(one), 1)).T):
                sums += np.bincount(keys[p] + field, minlength=sums.size).reshape(sums.shape)
            parts.append((kinds, np.bincount(of_pair.ravel()), sums))
        kinds, at = np.unique(np.concatenate([k for k, _, _ in parts]), return_inverse=True)
        n, sums = np.zeros(len(kinds), np.int64), np.zeros((len(kinds), fields))
        np.add.at(n, at, np.concatenate([x for _, x, _ in parts]))
        np.add.at(sums, at, np.concatenate([x for _, _, x in parts]))
        sums[:, -4:] *= -1  # costs
        return kinds, n, sums + 0.0

    def path_dots(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The gradient of every pair's best path times ``values``, a number a field; a row for each of ``a``."""
        out = np.zeros((len(a), len(b)))
        signed = np.concatenate([values[:-4], -values[-4:]])
        for x, y, score, ends, one, wide in self._paths(a, b):
            dots = np.zeros(score.size)
            for p, field in self._trace(self.tables, score.ravel() // self.unit, ends, np.repeat(one, wide, axis=0).T, np.tile(b[y], (len(one), 1)).T):
                dots[p] += signed[field]
            out[x, y] = dots.reshape(score.shape)
        return out

    def _paths(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        """Parts of all pairs, with their scores and ends; their states are in ``tables`` until the next part."""
        width = max(1, PATH_BYTES // (3 * (self.m + self.n + 1) * (self.m + 1) * self.kind.itemsize))
        if self.tables is None or self.tables.shape[-1] < width:
            self.tables = self._tables((3, self.m + self.n + 1, self.m + 1, width))
        for x, y, profile in self.blocks(a, b, width):
            one, wide = a[x], profile.shape[1]
            yield x, y, *self._fill(one, profile, wide, self.tables[..., : len(one) * wide]), one, wide

    def _tables(self, shape: tuple[int, ...]) -> np.ndarray:
        """States M, X and Y of every diagonal, with their borders; out of reach: the smallest number there is."""
        out, mode = np.full(shape, self.low, self.kind), self.s.mode
        for j in range(self.n + 1):
            if mode == "global" and j:
                out[2, j, 0] = -self.oa
            else:
                out[0, j, 0] = j * self.ea
        for i in range(1, self.m + 1):
            if mode == "local":
                out[0, i, i] = i * self.eb
            else:
                out[1, i, i] = -self.ob
        return out

    def _trace(self, tables: np.ndarray, score: np.ndarray, ends, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Along every best path, backwards: (pairs, field) that a move counts, a pair once at most."""
        square, opens = self.size * self.size, self.s.model == "affine"
        for p, i, j, state, was in self._steps(tables, score, ends):
            q = np.flatnonzero(state == 0)
            yield p[q], a[i[q] - 1, p[q]].astype(np.int64) * self.size + b[j[q] - 1, p[q]]
            if len(q) < len(p):
                in_b, in_a = state == 1, state == 2
                yield p[in_b], square + 3
                yield p[in_a], square + 1
                if opens:
                    new = was != state
                    yield p[in_b & new], square + 2
                    yield p[in_a & new], square

    def _steps(self, tables: np.ndarray, score: np.ndarray, ends) -> Iterator[tuple[np.ndarray, ...]]:
        """Every best path's moves, backwards: (pairs, the cells' rows and columns, states there and before).  Ties M, X, Y."""
        m, n, mode, pairs, most = self.m, self.n, self.s.mode, len(score), tables.shape[-1]
        states = [x.ravel() for x in tables]
        cell = lambda i, j, p: ((i + j) * (m + 1) + i) * most + p
        at = lambda where: [np.take(x, where) for x in states]
        p = np.arange(pairs)
        if mode == "local":
            p = np.flatnonzero(score > 0)
            i, j = ends[p], np.zeros(len(p), np.int64)
            gaps = () if self.ob + self.eb > 0 and self.oa + self.ea > 0 else (1, 2)  # a gap that costs something ends no best path
            left = np.arange(len(p))
            for col in range(1, n + 1):  # the first column of the row that has the score
                q, r = p[left], i[left]
                where = cell(r, col, q)
                top = np.take(states[0], where)
                for k in gaps:
                    top = np.maximum(top, np.take(states[k], where))
                hit = top - self.added(r, col) == score[q]
                j[left[hit]] = col
                left = left[~hit]
                if not len(left):
                    break
        else:
            i, j = np.full(pairs, m), np.full(pairs, n)
            if mode == "glocal":  # the first of equal columns
                left = p
                for col in range(n + 1):
                    hit = np.maximum.reduce(at(cell(m, col, left))) - self.added(m, col) == score[left]
                    j[left[hit]] = col
                    left = left[~hit]
        state = best_state(at(cell(i, j, p)))
        if mode != "local":
            go = (i > 0) | (j > 0) if mode == "global" else i > 0
            p, i, j, state = p[go], i[go], j[go], state[go]
        while len(p):
            to_i, to_j = i, j
            i, j = i - (state != 2), j - (state != 1)
            mv, x, y = at(cell(i, j, p))
            if not state.any():
                was = best_state([mv, x, y])
            else:
                in_b, in_a = state == 1, state == 2
                mv, x, y = (v.astype(np.int64) for v in (mv, x, y))
                cost = np.where(in_b, self.ob, np.where(in_a, self.oa, 0))
                was = best_state([mv - cost, x - np.where(in_a, cost, 0), y - np.where(in_b, cost, 0)])
            yield p, to_i, to_j, state, was
            if mode == "local":
                go = (was != 0) | (mv > self.added(i, j))
            else:
                go = (i > 0) | (j > 0) if mode == "global" else i > 0
            p, i, j, state = p[go], i[go], j[go], was[go]

    def _border(self, d: int, gap: int) -> int:
        return -gap if d else 0

    def _ranges(self, banded: bool) -> list[tuple[int, int]]:
        """The rows of each diagonal that are filled, away from both borders and within the band, end exclusive."""
        d = np.arange(self.m + self.n + 1)
        lo, hi = np.maximum(1, d - self.n), np.minimum(self.m, d - 1) + 1
        if banded:  # a row's cells lie on the diagonals first to last
            first, last = (np.arange(self.m + 1) + x for x in self.band)
            lo, hi = np.maximum(lo, np.searchsorted(last, d)), np.minimum(hi, np.searchsorted(first, d, side="right"))
        return list(zip(lo.tolist(), np.maximum(lo, hi).tolist()))

    def _fill(self, a: np.ndarray, profile: np.ndarray, wide: int, tables=None, limits=None):
        """(scores, ends of local paths): with ``tables`` states M, X and Y of all diagonals are written there.

        ``limits``: first and last columns of each pair's rows, in place of the band around the main diagonal; local mode only.
        """
        m, n, mode, kind = self.m, self.n, self.s.mode, self.kind
        pairs, total = len(a) * wide, m + n
        codes = a.T.astype(np.intp) * n  # (m, sequences)
        h = [np.empty((m + 1, pairs), kind) for _ in range(3)]
        spare, minus = np.empty((m + 1, pairs), kind), np.empty((m + 1, pairs), kind)
        other = minus if self.oa == self.ob else np.empty((m + 1, pairs), kind)
        if tables is None:
            xs, y = np.full((total + m + 2, pairs), self.low, kind), np.full((m + 1, pairs), self.low, kind)
        level = np.empty(pairs, kind)
        rows = np.full((m + 1, pairs), 0, kind) if mode == "local" and tables is not None else None
        best = np.zeros(pairs, kind) if mode == "local" else np.full(pairs, np.iinfo(np.int64).min)
        # Rows down column 0, columns along row 0 and the last row's columns that a band leaves.
        down, along, last = m, n, (0, n)
        banded = self.band is not None and limits is None
        if banded:
            low, high = self.band
            down, along, last = int(np.cumprod(low[1:] == 0).sum()), int(high[0]), (int(low[m]), int(high[m]))
            for x in h:
                x.fill(self.outside)
        for d, (lo, hi) in enumerate(self._ranges(banded)):
            now, one, two = h[d % 3], h[(d - 1) % 3], h[(d - 2) % 3]
            if banded:  # the range moves by a row at most: no other cell is read
                now[max(lo - 2, 0) : lo] = self.outside
                now[hi : hi + 2] = self.outside
            if lo < hi:
                up, here = slice(lo - 1, hi - 1), slice(lo, hi)
                np.subtract(one[lo - 1 : hi], kind.type(self.ob), out=minus[lo - 1 : hi])
                if other is not minus:
                    np.subtract(one[here], kind.type(self.oa), out=other[here])
                index = codes[up] + (d - 1 - np.arange(lo, hi))[:, None]
                found = spare[here].reshape(hi - lo, len(a), wide)
                np.take(profile, index, axis=0, out=found, mode="clip")
                if tables is None:
                    x = xs[lo - d + total : hi - d + total]  # a row of X moves down with each diagonal
                    x_was, y_was, y_now, into = x, y[here], y[here], now[here]
                else:
                    x, x_was = tables[1][d, here], tables[1][d - 1, up]
                    y_now, y_was, into = tables[2][d, here], tables[2][d - 1, here], tables[0][d, here]
                np.maximum(x_was, minus[up], out=x)
                np.maximum(y_was, other[here], out=y_now)
                np.add(two[up], spare[here], out=into)
                same = self.ea == self.eb
                zero = kind.type(d * self.ea) if same else self.added(np.arange(lo, hi), d - np.arange(lo, hi)).astype(kind)[:, None]
                if mode == "local":
                    if same:  # a row of them is quicker than one number
                        level.fill(zero)
                    np.maximum(into, level if same else zero, out=into)
                if limits is not None:
                    j = (d - np.arange(lo, hi)).astype(limits[0].dtype)[:, None]
                    beyond = np.less(j, limits[0][here])
                    beyond |= np.greater(j, limits[1][here])
                    most = np.multiply(beyond.view(np.int8), kind.type(self.outside - self.cap), out=spare[here], casting="unsafe")
                    most += kind.type(self.cap)
                    for states in (into, x, y_now):
                        np.minimum(states, most, out=states)
                np.maximum(into, x, out=now[here])
                np.maximum(now[here], y_now, out=now[here])
                if rows is not None:
                    np.subtract(now[here], zero, out=spare[here])
                    np.maximum(rows[here], spare[here], out=rows[here])
                elif mode == "local":
                    if same:
                        np.maximum(best, _top(now[here], spare[here]) - zero, out=best)
                    else:
                        np.subtract(now[here], zero, out=spare[here])
                        np.maximum(best, _top(spare[here], spare[here]), out=best)
            if d <= n:
                now[0] = (self._border(d, self.oa) if d <= along else self.outside) if mode == "global" else d * self.ea
            if 0 < d <= m:
                now[d] = d * self.eb if mode == "local" else -self.ob if d <= down else self.outside
            if mode == "glocal" and last[0] <= d - m <= last[1]:
                np.maximum(best, now[m].astype(np.int64) - self.added(m, d - m), out=best)
        if mode == "global":
            best = now[m].astype(np.int64) - self.added(m, n)
        ends = None
        if rows is not None:
            ends = rows.argmax(axis=0)  # the first row that holds the maximum
            best = rows[ends, np.arange(pairs)].astype(np.int64)
        return best.astype(np.int64).reshape(len(a), wide) * self.unit, ends


class _Rows:
    """Local scores row by row: one sequence against many at once, whose letters are the rows of an array.

    As in :class:`Crossed`, extends are added back, so a cell's zero is its diagonal's, and the best of each diagonal is
    kept.  Gaps along a row are followed for ``REACH`` letters: a longer one needs a better score before it.  Sequences
    are taken in order; each goes on from the row that it shares with the one before.
    """

    def __init__(self, weights: np.ndarray, extend: int, down: int, along: int):
        self.weights, self.extend, self.down, self.along, self.kind = weights, extend, down, along, weights.dtype

    def fill(self, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
        order = np.lexsort(a.T[::-1])
        a = a[order]
        shared = [0, *(a[1:] != a[:-1]).argmax(axis=1).tolist()]
        for x in np.flatnonzero((a[1:] == a[:-1]).all(axis=1)).tolist():
            shared[x + 1] = a.shape[1]
        kept: list[set[int]] = [set() for _ in shared]  # rows of each sequence that a later one goes on from
        above: list[int] = []
        for x, row in enumerate(shared):
            while above and shared[above[-1]] >= row > 0:
                above.pop()
            if row:
                kept[above[-1]].add(row)
            above.append(x)
        parts = -(-len(b) // WIDE)
        for part in np.array_split(np.arange(len(b)), parts):
            self._against(a.tolist(), shared, kept, b[part], order, out[:, part[0] : part[-1] + 1])

    def _against(self, a: list[list[int]], shared: list[int], kept: list[set[int]], b: np.ndarray, order: np.ndarray, out: np.ndarray) -> None:
        kind, wide, n, m = self.kind, len(b), b.shape[1], len(a[0])
        low, along, down = np.iinfo(kind).min, kind.type(self.along), kind.type(self.down)
        zeros = np.repeat(np.arange(m + n + 1).astype(kind) * kind.type(self.extend), wide).reshape(-1, wide)
        profile = [np.ascontiguousarray(self.weights[c][b.T]).ravel() for c in range(len(self.weights))]
        # A gap pays if what is aligned before and after it is worth more: not within so many letters of an end.
        most = max(1, int(self.weights.max()) - 2 * self.extend)
        margin = (min(self.along, self.down) + self.extend) // most
        gapped = max(0, n - 2 * margin)  # columns where gaps begin, from the one after the margin
        # What a row leaves: the best of each diagonal, gaps that run down, and the cells with their left border, by turns here and there.
        best, gaps = np.empty_like(zeros), np.empty((gapped, wide), kind)
        turns = [np.empty((n + 1, wide), kind) for _ in range(2)]
        opened = np.full((gapped + 4, wide), low, kind)  # a gap opened at each cell, below four that none comes from
        fresh, one, two = opened[4:].ravel(), opened[1 : gapped + 3].ravel(), opened[: gapped + 2].ravel()
        near = np.empty((gapped + 2, wide), kind)
        ends, near, far = near.ravel(), near[2:].ravel(), near[:gapped].ravel()
        inner = slice(1 + margin, 1 + margin + gapped)
        cells = [(x[:n].ravel(), x[0], x[1:].ravel(), x[inner].ravel()) for x in turns]
        rows = [(zeros[i : i + n].ravel(), best[i : i + n].ravel()) for i in range(2, m + 2)]
        rest, gap, gaps = np.empty_like(best), np.empty(gapped * wide, kind), gaps.ravel()
        saved = {0: (zeros.copy(), np.full_like(gaps, low), zeros[: n + 1].copy())}
        add, subtract, larger = np.add, np.subtract, np.maximum
        for x, letters in enumerate(a):
            start = shared[x]
            best[:], gaps[:], turns[start % 2][:] = saved[start]
            for i in range(start, m):
                zero, top = rows[i]
                _, border, now, within = cells[(i + 1) % 2]
                add(cells[i % 2][0], profile[letters[i]], now)
                larger(now, zero, now)
                if gapped and margin <= i < m - margin:
                    larger(within, gaps, within)
                    subtract(within, along, fresh)
                    if along == down:
                        larger(gaps, fresh, gaps)
                    else:
                        subtract(within, down, gap)
                        larger(gaps, gap, gaps)
                    larger(top, now, top)
                    larger(one, two, ends)
                    larger(within, near, within)
                    larger(within, far, within)
                else:
                    larger(top, now, top)
                border.fill((i + 1) * self.extend)
                if i + 1 in kept[x]:
                    saved[i + 1] = best.copy(), gaps.copy(), turns[(i + 1) % 2].copy()
            subtract(best, zeros, rest)
            out[order[x]] = _top(rest, rest)
