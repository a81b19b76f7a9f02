"""Cutting texts where no tokenizer merge can cross, and memoising tokens per piece.

Both tokenizers used here treat a text as a sequence of pieces that begin at a
space.  Wherever a plain space follows a character that is surely not white
space, tokens never span that position.  Cutting there, encoding each distinct
piece once and gathering the results equals encoding the whole text.  Where
the preceding character could be white space (other blanks, three-byte
characters, U+2581), no cut is made: pieces get longer, results stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, first): all pieces in order, and where each text's pieces begin (one more entry at the end).

    Nulls count as empty; an empty text has no pieces.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    base, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    offsets = offsets - base
    mark = np.zeros(raw.size + 1, dtype=bool)
    space = np.flatnonzero(raw == 0x20)
    space = space[space > 0]
    before = raw[space - 1]
    earlier = raw[np.maximum(space - 2, 0)]
    mark[space] = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (earlier >= 0xC3) & (earlier <= 0xDF))
    mark[offsets] = True  # also where one text ends and the next begins
    mark[-1] = False
    starts = np.flatnonzero(mark)
    bounds = np.append(starts, raw.size)
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)]) if len(starts) else pa.array([], pa.large_string())
    return pieces, np.searchsorted(starts, offsets)


def ragged(values_first: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Positions of the values of the picked runs, run after run."""
    n = lengths[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(values_first[pick] - (ends - n), n)


class Numbers:
    """Numbers of the distinct strings that a Python worker has met, in the order of their arrival.

    They are held as one Arrow array, so that only new strings ever become
    Python objects.  Up to ``most`` stay; what comes beyond is numbered for one
    batch and then forgotten (:attr:`kept` tells how many stay).
    """

    def __init__(self, most: int):
        self.most, self.known = most, pa.array([], pa.large_string())

    @property
    def kept(self) -> int:
        return len(self.known)

    def look_up(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(numbers of distinct ``strings``, the new ones): new strings are numbered from :attr:`kept` on."""
        found = pc.index_in(strings, value_set=self.known)
        out = found.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(out < 0)
        out[new] = len(self.known) + np.arange(len(new))
        return out, strings.take(pa.array(new))

    def keep(self, new: pa.Array) -> int:
        """Remember the first of the strings that were new, as far as there is room; returns how many stay."""
        n = min(len(new), self.most - len(self.known))
        if n:
            self.known = pa.concat_arrays([self.known, new.slice(0, n)])
        return n
