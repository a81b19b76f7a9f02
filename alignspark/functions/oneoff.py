"""Functions of a single pair, named by algorithm, output and number type.

``nw`` global, ``sw`` local, ``glocal`` A within B; linear gaps, or affine ones
with ``affine``; scores, hard or soft gradients; no suffix for 32-bit floats,
``_double``, ``_int8`` to ``_int64`` for the others.  A handful of pairs is all
they are for: many pairs belong in a DataFrame (:mod:`alignspark.operators.align`).
"""

from __future__ import annotations

import numpy as np

from alignspark.operators.align import Problem, choice, CHOICES, solve
from alignspark.params import AlignParams

_MODES = {"nw": "global", "sw": "local", "glocal": "glocal"}
_TYPES = {"": "float32", "_double": "float64", "_int8": "int8", "_int16": "int16", "_int32": "int32", "_int64": "int64"}


def guide_j_from_aligned(a_al: str, b_al: str) -> list[int]:
    """The column after each residue of A, from two gapped strings."""
    if len(a_al) != len(b_al):
        raise ValueError("aligned strings must have equal length")
    if any(x == y == "-" for x, y in zip(a_al, b_al, strict=True)):
        raise ValueError("aligned strings have a column with two gaps")
    seen = np.cumsum([c != "-" for c in b_al], dtype=int)
    return [0] + [int(j) for c, j in zip(a_al, seen, strict=True) if c != "-"]


def _run(problem: Problem, a: str, b: str, params: AlignParams, aligned_a: str, aligned_b: str, track, gap_track):
    problem.check(params)
    if bool(aligned_a) != bool(aligned_b):
        raise ValueError("a guide needs both aligned strings")
    guides = [guide_j_from_aligned(aligned_a, aligned_b)] if aligned_a else None
    codes = [params.alphabet.codes(a)], [params.alphabet.codes(b)]
    return solve([0], *codes, params, problem, guides, None if track is None else [track], None if gap_track is None else [gap_track], paths=False)[0]


def _make(name: str, mode: str, model: str, grad: str, precision: str):
    def call(a, b, params, band=0, aligned_a="", aligned_b="", kernel="auto", *, track=None, gap_track=None, soft_impl="scaled", temperature=1.0):
        choice("kernel", kernel, CHOICES["kernel"])
        r = _run(Problem(mode, model, grad, precision, temperature, band, soft_impl=soft_impl), a, b, params, aligned_a, aligned_b, track, gap_track)
        if grad == "none":
            return r["score"]
        flat = np.zeros(params.num_sets * params.n_fields)
        flat[r["grad"][0]] = r["grad"][1]
        return r["score"], params.like_flat(flat)

    call.__name__ = call.__qualname__ = name
    call.__doc__ = f"{'Score' if grad == 'none' else 'Score and gradient' if grad == 'hard' else 'log Z and expected counts'} of a {mode} alignment with {model} gaps ({precision})."
    return call


def _all() -> dict:
    out = {}
    for short, mode in _MODES.items():
        for model in ("linear", "affine"):
            mid = "_affine" if model == "affine" else ""
            for suffix, precision in _TYPES.items():
                out[f"{short}_score{mid}{suffix}"] = (mode, model, "none", precision)
                out[f"{short}{mid}_grad{suffix}"] = (mode, model, "hard", precision)
                if not precision.startswith("int"):
                    out[f"{short}{mid}_soft_grad{suffix}"] = (mode, model, "soft", precision)
    return out


NAMES = sorted(_all())
globals().update({name: _make(name, *spec) for name, spec in _all().items()})
__all__ = ["guide_j_from_aligned", *NAMES]
