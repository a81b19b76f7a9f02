"""Alphabets: ordered symbols that sequences, matrices and gradients share."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class Alphabet:
    """An immutable ordered set of 1 to 127 ASCII symbols; ``-`` stands for gaps and is none of them."""

    def __init__(self, symbols: str):
        if not symbols:
            raise ValueError("an alphabet needs at least one symbol")
        if len(symbols) > 127:
            raise ValueError(f"an alphabet holds at most 127 symbols, not {len(symbols)}")
        for ch in symbols:
            if not ch.isascii():
                raise ValueError(f"alphabet symbol {ch!r} is not ASCII")
            if ch == "-":
                raise ValueError("'-' is the gap and cannot be a symbol")
            if symbols.count(ch) > 1:
                raise ValueError(f"alphabet symbol {ch!r} occurs twice")
        self.symbols = symbols
        self.table = np.full(256, 255, np.uint8)
        self.table[np.frombuffer(symbols.encode(), np.uint8)] = np.arange(len(symbols), dtype=np.uint8)

    @staticmethod
    def get(symbols: str) -> Alphabet:
        """The one alphabet of these symbols."""
        return _get(symbols)

    @property
    def size(self) -> int:
        return len(self.symbols)

    def __len__(self) -> int:
        return len(self.symbols)

    def __eq__(self, other) -> bool:
        return isinstance(other, Alphabet) and self.symbols == other.symbols

    def __hash__(self) -> int:
        return hash(self.symbols)

    def __repr__(self) -> str:
        return f"Alphabet({self.symbols!r})"

    def __reduce__(self):
        return _get, (self.symbols,)

    def index_of(self, c: str) -> int:
        return self.symbols.find(c) if len(c) == 1 else -1

    def contains(self, c: str) -> bool:
        return self.index_of(c) >= 0

    def codes(self, s: str) -> np.ndarray:
        """Indices of a sequence; a foreign character raises with its place."""
        raw = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        out = self.table[np.minimum(raw, 255)]
        if (out == 255).any():
            at = int((out == 255).argmax())
            raise ValueError(f"character {s[at]!r} (0x{ord(s[at]):02x}) at position {at} is not in the alphabet {self.symbols!r}")
        return out

    def encode(self, s: str) -> list[int]:
        return self.codes(s).tolist()

    def decode(self, indices) -> str:
        return "".join(self.symbols[i] for i in indices)


@lru_cache(maxsize=None)
def _get(symbols: str) -> Alphabet:
    return Alphabet(symbols)


# The usual symbol orders.
DNA = _get("ACGT")
DNA_N = _get("ACGTN")
RNA = _get("ACGU")
RNA_N = _get("ACGUN")
PROTEIN = _get("ACDEFGHIKLMNPQRSTVWY")
PROTEIN_X = _get("ACDEFGHIKLMNPQRSTVWYX")
PROTEIN_UO = _get("ACDEFGHIKLMNPQRSTVWYUO")
PROTEIN_UOX = _get("ACDEFGHIKLMNPQRSTVWYUOX")
NCBI_PROTEIN = _get("ARNDCQEGHILKMFPSTWYVBZX")
IUPAC_DNA = _get("ATGCSWRYKMBVHDN")
