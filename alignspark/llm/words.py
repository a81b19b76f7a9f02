"""Words of texts as 64-bit hashes, a batch at a time with numpy.

Separators are ASCII bytes, so UTF-8 texts are cut byte by byte; A-Z count as
a-z.  A word's hash is a polynomial over its bytes, mixed; a shingle's hash is
a polynomial over its words' hashes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step handles (it takes some fifty times that memory); a longer text is a step of its own.
STEP = 1_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Everything but white space.
BLANKS = np.ones(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters, digits and non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def steps(texts: pa.Array, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text; a longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def words(texts: pa.Array, kept: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): text i has the words hashes[first[i]:first[i + 1]].  Nulls have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    if base == end:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[base:end]]
    offsets = offsets - base
    inside = kept[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < raw.size]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(inside)
    head = np.searchsorted(at, starts)
    size = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, size)
    powers = np.full(int(size.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    hashes = mix(np.add.reduceat(_BYTE[raw[at]] * powers[place], head) + size.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all runs of n words; a text of fewer words, but not none, has one run of all its words."""
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(runs)])
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, np.uint64), out_first
    at = np.arange(total) + np.repeat(first[:-1] - out_first[:-1], runs)
    length = np.repeat(np.minimum(count, n), runs)
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        use = k < length
        acc = np.where(use, acc * _BASE + hashes[np.minimum(at + k, len(hashes) - 1)], acc)
    return mix(acc + length.astype(np.uint64)), out_first
