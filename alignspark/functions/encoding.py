"""Alphabet functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from alignspark.alphabet import Alphabet
from alignspark.params import SubstMatrix


def _class(alphabet: Alphabet) -> str:
    return "".join(re.escape(c) for c in alphabet.symbols)


def is_valid(seq: Column, alphabet: Alphabet) -> Column:
    return seq.rlike(f"^[{_class(alphabet)}]*$") & ~seq.contains("\n")


def first_foreign(seq: Column, alphabet: Alphabet) -> Column:
    """Position (from 0) of the first character outside the alphabet, -1 if there is none."""
    return F.regexp_instr(seq, F.lit(f"[^{_class(alphabet)}]")) - 1


def index_of(symbol: Column, alphabet: Alphabet) -> Column:
    return F.when(F.length(symbol) == 1, F.position(symbol, F.lit(alphabet.symbols)) - 1).otherwise(-1)


def contains(symbol: Column, alphabet: Alphabet) -> Column:
    return index_of(symbol, alphabet) >= 0


def encode(seq: Column, alphabet: Alphabet) -> Column:
    """Indices of the symbols; a foreign character raises with its place."""
    bad = first_foreign(seq, alphabet)
    codes = F.when(F.length(seq) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(seq, "(?!^)(?!$)"), lambda c: (F.position(c, F.lit(alphabet.symbols)) - 1).cast("int")))
    message = F.concat(F.lit("character at position "), bad.cast("string"), F.lit(f" is not in the alphabet {alphabet.symbols}"))
    return F.when(bad >= 0, F.raise_error(message).cast("array<int>")).otherwise(codes)


def decode(codes: Column, alphabet: Alphabet) -> Column:
    return F.array_join(F.transform(codes, lambda i: F.substring(F.lit(alphabet.symbols), i + 1, F.lit(1))), "")


def pair_score(a: Column, b: Column, matrix: SubstMatrix) -> Column:
    """The matrix's score of two symbols; null outside the alphabet."""
    flat = F.array(*(F.lit(float(x)) for x in matrix.values.ravel()))
    i, j = index_of(a, matrix._alphabet), index_of(b, matrix._alphabet)
    return F.when((i >= 0) & (j >= 0), F.get(flat, (i * matrix.size + j).cast("int")))
