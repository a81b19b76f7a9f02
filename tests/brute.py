"""Every alignment of two short sequences, one by one: the oracle of the dynamic programs."""

from __future__ import annotations

import math


def paths(m, n, mode):
    """(start, moves) of all alignments of the ensemble; a move is M, X (gap in B) or Y (gap in A)."""
    starts = {"global": [(0, 0)], "glocal": [(0, j) for j in range(n + 1)], "local": [(i, j) for i in range(m + 1) for j in range(n + 1)]}[mode]
    for start in starts:
        stack = [(start, "")]
        while stack:
            (i, j), moves = stack.pop()
            if mode == "local" or (i == m and (mode == "glocal" or j == n)):
                yield start, moves
            for move, di, dj in (("M", 1, 1), ("X", 1, 0), ("Y", 0, 1)):
                a, b = i + di, j + dj
                if a > m or b > n:
                    continue
                if mode == "glocal" and move == "Y" and i == 0:
                    continue  # row 0 is free, not gapped
                if mode == "local" and ((move == "X" and b == 0) or (move == "Y" and a == 0)):
                    continue  # borders are starts, not gaps
                stack.append(((a, b), moves + move))


def counts(a, b, start, moves, model, n_sym, track, gap_track):
    """{field: count} of one alignment, gaps negative."""
    fields, out = n_sym * n_sym + 4, {}
    i, j, last = *start, ""

    def add(f, v):
        out[f] = out.get(f, 0) + v

    for mv in moves:
        i, j = i + (mv != "Y"), j + (mv != "X")
        s = (gap_track[i] if mv == "Y" else track[i - 1]) * fields
        if mv == "M":
            add(s + a[i - 1] * n_sym + b[j - 1], 1)
        else:
            off = n_sym * n_sym + (2 if mv == "X" else 0)
            add(s + off + 1, -1)
            if mv != last and model == "affine":
                add(s + off, -1)
        last = mv
    return out


def ensemble(a, b, flat, n_sym, mode, model, track=None, gap_track=None):
    """(best score, [(count, fields)] of best paths, log Z, expected counts).

    In the local affine ensemble an alignment starts in the M state of a cell.
    """
    track = track if track is not None else [0] * len(a)
    gap_track = gap_track if gap_track is not None else [track[0] if len(a) else 0, *track]
    rows = []
    for start, moves in paths(len(a), len(b), mode):
        c = counts(a, b, start, moves, model, n_sym, track, gap_track)
        rows.append((sum(flat[f] * v for f, v in c.items()), c))
    best = max(s for s, _ in rows)
    z = sum(math.exp(s) for s, _ in rows)
    mean: dict = {}
    for s, c in rows:
        for f, v in c.items():
            mean[f] = mean.get(f, 0.0) + math.exp(s) / z * v
    return best, [c for s, c in rows if abs(s - best) < 1e-9], math.log(z), mean
