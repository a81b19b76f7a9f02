"""Substitution matrices and alignment parameters, which are also the gradient's type."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from alignspark.alphabet import PROTEIN, Alphabet

#: Order of the four gap fields.
GAP_FIELDS = ("gap_open_a", "gap_extend_a", "gap_open_b", "gap_extend_b")
MAX_SETS = 65536


class SubstMatrix:
    """A dense square matrix of scores over an alphabet; it need not be symmetric."""

    def __init__(self, matrix, alphabet: str = PROTEIN.symbols):
        self._alphabet = Alphabet.get(alphabet)
        values = np.array(matrix, dtype=np.float64)
        n = len(self._alphabet)
        if values.ndim != 2 or values.shape[0] != values.shape[1]:
            raise ValueError(f"a substitution matrix must be square, not of shape {values.shape}")
        if values.shape[0] != n:
            raise ValueError(f"a matrix of {values.shape[0]} rows needs as many symbols, not {n}")
        self.values = values

    @property
    def size(self) -> int:
        return len(self._alphabet)

    @property
    def alphabet(self) -> str:
        return self._alphabet.symbols

    def to_matrix(self) -> np.ndarray:
        return self.values.copy()

    def score(self, a: str, b: str) -> float:
        i, j = self._alphabet.index_of(a), self._alphabet.index_of(b)
        if i < 0 or j < 0:
            raise ValueError(f"character {(a if i < 0 else b)!r} is not in the alphabet {self.alphabet!r}")
        return float(self.values[i, j])

    def __repr__(self) -> str:
        return f"SubstMatrix({self.size}x{self.size}, {self.alphabet!r})"


class AlignParams:
    """K sets of a substitution matrix and four gap penalties.  The plain fields are those of set 0."""

    def __init__(self, matrix, gap_open_a: float = 0.0, gap_extend_a: float = 0.0, gap_open_b: float = 0.0, gap_extend_b: float = 0.0, *, alphabet: str | None = None):
        if not isinstance(matrix, SubstMatrix):
            matrix = SubstMatrix(matrix, alphabet or PROTEIN.symbols)
        self.alphabet = Alphabet.get(matrix.alphabet)
        self._matrices = matrix.values[None].copy()
        self._gaps = np.array([[gap_open_a, gap_extend_a, gap_open_b, gap_extend_b]], dtype=np.float64)

    @classmethod
    def from_arrays(cls, matrices, gaps, alphabet: str = PROTEIN.symbols) -> AlignParams:
        m, g, n = np.array(matrices, np.float64), np.array(gaps, np.float64), len(Alphabet.get(alphabet))
        if m.ndim != 3 or m.shape[1:] != (n, n) or not 1 <= len(m) <= MAX_SETS:
            raise ValueError(f"matrices must have the shape (K, {n}, {n}), not {m.shape}")
        if g.shape != (len(m), 4):
            raise ValueError(f"gaps must have the shape ({len(m)}, 4), not {g.shape}")
        out = cls(SubstMatrix(m[0], alphabet), *g[0])
        out._matrices, out._gaps = m, g
        return out

    @classmethod
    def stack(cls, sets: Sequence[AlignParams]) -> AlignParams:
        if not sets:
            raise ValueError("no parameter sets to stack")
        if any(p.num_sets != 1 or p.alphabet != sets[0].alphabet for p in sets):
            raise ValueError("stacked parameters must have one set each and the same alphabet")
        return cls.from_arrays(np.concatenate([p._matrices for p in sets]), np.concatenate([p._gaps for p in sets]), sets[0].alphabet.symbols)

    @property
    def num_sets(self) -> int:
        return len(self._matrices)

    @property
    def matrices(self) -> np.ndarray:
        return self._matrices.copy()

    @matrices.setter
    def matrices(self, values) -> None:
        values = np.array(values, np.float64)
        if values.shape != self._matrices.shape:
            raise ValueError(f"matrices must keep the shape {self._matrices.shape}")
        self._matrices = values

    @property
    def gaps(self) -> np.ndarray:
        return self._gaps.copy()

    @gaps.setter
    def gaps(self, values) -> None:
        values = np.array(values, np.float64)
        if values.shape != self._gaps.shape:
            raise ValueError(f"gaps must keep the shape {self._gaps.shape}")
        self._gaps = values

    @property
    def matrix(self) -> SubstMatrix:
        return SubstMatrix(self._matrices[0], self.alphabet.symbols)

    @matrix.setter
    def matrix(self, m: SubstMatrix) -> None:
        if m.alphabet != self.alphabet.symbols:
            raise ValueError("the matrix has another alphabet")
        self._matrices[0] = m.values

    def __getitem__(self, k: int) -> AlignParams:
        return AlignParams(SubstMatrix(self._matrices[self._set(k)], self.alphabet.symbols), *self._gaps[self._set(k)])

    def __setitem__(self, k: int, p: AlignParams) -> None:
        if p.num_sets != 1 or p.alphabet != self.alphabet:
            raise ValueError("a set is assigned from one-set parameters with the same alphabet")
        self._matrices[self._set(k)], self._gaps[self._set(k)] = p._matrices[0], p._gaps[0]

    def _set(self, k: int) -> int:
        if not -self.num_sets <= k < self.num_sets:
            raise IndexError(f"set {k} of {self.num_sets}")
        return k % self.num_sets

    def copy(self) -> AlignParams:
        return AlignParams.from_arrays(self._matrices, self._gaps, self.alphabet.symbols)

    def zeros_like(self) -> AlignParams:
        return self * 0.0

    def zero(self) -> None:
        self._matrices[:], self._gaps[:] = 0.0, 0.0

    def _with(self, f, other=None) -> AlignParams:
        if isinstance(other, AlignParams):
            if other.alphabet != self.alphabet:
                raise ValueError("parameters over different alphabets cannot be combined")
            if other.num_sets != self.num_sets:
                raise ValueError(f"parameters of {self.num_sets} and {other.num_sets} sets cannot be combined")
            m, g = other._matrices, other._gaps
        else:
            m = g = other
        return AlignParams.from_arrays(f(self._matrices, m), f(self._gaps, g), self.alphabet.symbols)

    def __add__(self, other: AlignParams) -> AlignParams:
        return self._with(np.add, other) if isinstance(other, AlignParams) else NotImplemented

    def __sub__(self, other: AlignParams) -> AlignParams:
        return self._with(np.subtract, other) if isinstance(other, AlignParams) else NotImplemented

    def __mul__(self, scalar: float) -> AlignParams:
        return self._with(np.multiply, float(scalar))

    __rmul__ = __mul__

    def __neg__(self) -> AlignParams:
        return self * -1.0

    def __iadd__(self, other: AlignParams) -> AlignParams:
        return self._take(self + other)

    def __isub__(self, other: AlignParams) -> AlignParams:
        return self._take(self - other)

    def __imul__(self, scalar: float) -> AlignParams:
        return self._take(self * scalar)

    def _take(self, other: AlignParams) -> AlignParams:
        self._matrices, self._gaps = other._matrices, other._gaps
        return self

    # The flat form: for each set the matrix row by row, then the gap fields.
    @property
    def n_fields(self) -> int:
        return len(self.alphabet) ** 2 + 4

    def flat(self) -> np.ndarray:
        return np.concatenate([self._matrices.reshape(self.num_sets, -1), self._gaps], axis=1).ravel()

    def like_flat(self, values: np.ndarray) -> AlignParams:
        rows = np.asarray(values, np.float64).reshape(self.num_sets, self.n_fields)
        n = len(self.alphabet)
        return AlignParams.from_arrays(rows[:, : n * n].reshape(-1, n, n), rows[:, n * n :], self.alphabet.symbols)

    def dot(self, other: AlignParams) -> float:
        return float(self.flat() @ other.flat())

    def to_dict(self) -> dict:
        out = {"matrix": self._matrices[0].copy(), "alphabet": self.alphabet.symbols} | dict(zip(GAP_FIELDS, self._gaps[0].tolist(), strict=True))
        if self.num_sets > 1:
            out |= {"num_sets": self.num_sets, "matrices": self.matrices, "gaps": self.gaps}
        return out


def _gap_field(k: int, name: str) -> property:
    def read(self: AlignParams) -> float:
        return float(self._gaps[0, k])

    def write(self: AlignParams, value: float) -> None:
        self._gaps[0, k] = value

    return property(read, write, doc=f"{name} of set 0")


for _k, _name in enumerate(GAP_FIELDS):
    setattr(AlignParams, _name, _gap_field(_k, _name))
