"""Exact token counts by prefix dynamic programming.

``count(prefix)`` obeys a recurrence.  Let a text be cut into pieces that no
token spans (see :mod:`alignspark.llm.segments`).  With C(0) = 0,
C(j) = C(j - 1) + tokens(piece j) is the exact count at each piece boundary.
Inside a piece, the last token of the encoding of a prefix is the only
vocabulary entry t that ends there and stays apart from the last token s
before it, that is, encode(s + t) = [s, t]; so
count(i) = count(i - |t|) + 1.  The table answers what a text costs, where to
cut it for a budget and what any prefix costs, without encoding again.

Defined results: null and empty texts have 0 bytes and 0 tokens; extra
columns are ignored; repeated rows give repeated rows; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignspark.llm.segments import Numbers, cut
from alignspark.llm.words import steps

MODEL = "piece_bpe_32k.model"
#: Distinct pieces that a Python worker remembers.
MEMO = 400_000
#: Bytes of text that are cut at a time.
CUT_BYTES = 2_000_000
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _processor(path: str, prefixed: bool = True):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if not prefixed:
        sp.OverrideNormalizerSpec(add_dummy_prefix=False)
    return sp


_memo: dict[str, tuple[Numbers, np.ndarray]] = {}


def piece_counts(path: str, pieces: pa.Array) -> np.ndarray:
    """Tokens of each distinct piece.  A piece brings its own leading space, which the library adds itself."""
    names, counts = _memo.get(path) or (Numbers(MEMO), np.zeros(0, np.int64))
    number, new = names.look_up(pieces)
    if not len(new):
        return counts[number]
    plain = new.to_pylist()
    added = np.fromiter(map(len, _processor(path).encode([p[1:] if p.startswith(" ") else p for p in plain], num_threads=1)), np.int64, len(plain))
    if " " in plain:  # the library drops a lone prefix
        added[plain.index(" ")] = 1
    every = np.concatenate([counts, added])
    _memo[path] = names, every[: len(counts) + names.keep(new)]
    return every[number]


def prefix_tables(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, ends, counts): text i owns entries first[i]:first[i + 1]; entry j says that the
    prefix up to byte ends[j] of its text has counts[j] tokens."""
    pieces, first = cut(texts)
    if not len(pieces):
        return first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pieces.dictionary_encode()
    each = piece_counts(path, coded.dictionary)[coded.indices.to_numpy()]
    opening = first[:-1][np.diff(first) > 0]
    opening = opening[pc.starts_with(pieces.take(pa.array(opening)), " ").to_numpy(zero_copy_only=False)]
    if len(opening):  # the library sets its prefix before the space that opens a text
        each[opening] = [len(x) for x in _processor(path).encode(pieces.take(pa.array(opening)).to_pylist(), num_threads=1)]
    size = pc.binary_length(pieces).to_numpy().astype(np.int64)
    owner_start = np.repeat(first[:-1], np.diff(first))
    run, length = np.cumsum(each), np.cumsum(size)
    return first, length - (length - size)[owner_start], run - (run - each)[owner_start]


def token_counts(df: DataFrame, text: str | Column = "text", id_col: str = "doc_id", limit: int = 4096, path: str | None = None, tables: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit and fits_chars of every whole text.

    ``fits_chars`` answers the budget question from the prefix table: the
    characters of the longest prefix of at most ``limit`` tokens (all of them
    where the text is within it).  With ``tables`` each row also carries its prefix table as ``prefix_bytes``
    and ``prefix_tokens`` (arrays, one entry for each piece boundary).
    No shuffle: one Arrow pass over the two columns that it reads.
    """
    path = path or model_path()
    src = df.select(F.col(id_col).alias("id"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fits_chars bigint" + ", prefix_bytes array<bigint>, prefix_tokens array<bigint>" * tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in steps(b.column(1), CUT_BYTES)):
            first, ends, counts = prefix_tables(path, batch.column(1))
            last, some = np.maximum(first[1:] - 1, 0), np.diff(first) > 0
            n = np.where(some, counts[last] if len(counts) else 0, 0)
            size = np.where(some, ends[last] if len(ends) else 0, 0)
            fits = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            for i in np.flatnonzero(n > limit).tolist():
                fits[i] = longest_within(batch.column(1)[i].as_py(), ends[first[i] : first[i + 1]], counts[first[i] : first[i + 1]], limit, path)
            out = [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(fits)]
            if tables:
                edge = pa.array(first.astype(np.int32))
                out += [pa.ListArray.from_arrays(edge, pa.array(ends)), pa.ListArray.from_arrays(edge, pa.array(counts))]
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit", "fits_chars"] + ["prefix_bytes", "prefix_tokens"] * tables
    return src.mapInArrow(run, schema)


class PiecePrefix:
    """Token count at every character prefix of one piece, by the recurrence above."""

    def __init__(self, path: str | None = None):
        self.sp = _processor(path or model_path())
        self.longest = max(len(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()))
        self.vocab = {self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))}
        self.apart: dict[tuple[str, str], bool] = {}

    def _stay_apart(self, s: str, t: str) -> bool:
        if (s, t) not in self.apart:
            if len(self.apart) > MEMO:
                self.apart.clear()
            # the line feed is spelled as a byte, merges with nothing and keeps the library's own prefix off
            self.apart[s, t] = self.sp.encode("\n" + (s + t).replace(SPACE, " "), out_type=str)[2:] == ([s, t] if s else [t])
        return self.apart[s, t]

    def counts(self, piece: str) -> list[int]:
        """counts[i]: tokens of the first i characters of a piece as it stands (with its space, no other prefix)."""
        x = piece.replace(" ", SPACE)
        n, last = [0] + [-1] * len(x), [""] * (len(x) + 1)
        for i in range(1, len(x) + 1):
            for j in range(max(0, i - self.longest), i):
                t = x[j:i]
                if t in self.vocab and self._stay_apart(last[j], t):
                    n[i], last[i] = n[j] + 1, t
                    break
            else:  # no vocabulary entry ends here: the library spells the character in bytes, which never merge
                n[i], last[i] = n[i - 1] + len(x[i - 1].encode()), ""
        return n


@lru_cache(maxsize=2)
def _prefix(path: str) -> PiecePrefix:
    return PiecePrefix(path)


def longest_within(text: str, ends: np.ndarray, counts: np.ndarray, budget: int, path: str) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from a text's prefix table.

    Counts at piece boundaries never fall, so only the piece that crosses the
    budget is looked at by character.
    """
    k = int(np.searchsorted(counts, budget, side="right"))
    if k == len(counts):
        return len(text)
    raw = text.encode()
    start, base = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
    piece = raw[start : int(ends[k])].decode()
    own = _prefix(path).counts(piece if k else " " + piece)[0 if k else 1 :]
    own[0] = 0
    return len(raw[:start].decode()) + max(i for i, c in enumerate(own) if base + c <= budget)


class PrefixIndex:
    """The whole table of one text: exact counts at every character prefix."""

    def __init__(self, text: str, prefix: PiecePrefix | None = None, path: str | None = None):
        self.text, prefix = text, prefix or PiecePrefix(path)
        pieces, _ = cut(pa.array([text], pa.large_string()))
        self.at = [0]
        for k, piece in enumerate(pieces.to_pylist()):
            own = prefix.counts(piece if k else " " + piece)
            base = self.at[-1]
            self.at += [base + c for c in own[1 if k else 2 :]]

    def count(self, n_chars: int) -> int:
        return self.at[n_chars]

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix that costs at most ``budget`` tokens."""
        return max(i for i, c in enumerate(self.at) if c <= budget)


def truncate_to_budget(df: DataFrame, budget: int, text: str = "text", path: str | None = None) -> DataFrame:
    """Every row with ``text`` cut to its longest prefix of at most ``budget`` tokens.

    A text within budget is returned as it is; null stays null.
    """
    path = path or model_path()

    @F.pandas_udf("string")
    def cut_all(texts):
        arr = pa.array(texts, pa.large_string(), from_pandas=True)
        first, ends, counts = prefix_tables(path, arr)
        out = []
        for i, t in enumerate(arr.to_pylist()):
            own = slice(first[i], first[i + 1])
            if t and counts[own][-1] > budget:
                t = t[: longest_within(t, ends[own], counts[own], budget, path)]
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    return df.withColumn(text, cut_all(F.col(text).cast("string")))
