"""Substitution matrices: by rule, by a short table, or read from NCBI-format files."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession

from alignspark.alphabet import IUPAC_DNA, NCBI_PROTEIN
from alignspark.params import SubstMatrix

# Which bases each IUPAC code stands for.
_BASES = {
    "A": "A", "T": "T", "G": "G", "C": "C", "S": "GC", "W": "AT", "R": "AG", "Y": "CT", "K": "GT", "M": "AC",
    "B": "CGT", "V": "ACG", "H": "ACT", "D": "AGT", "N": "ACGT",
}
_MATCH, _MISMATCH = 5, -4


def _nucleotide(x: str, y: str) -> int:
    """The mean score of the bases that two codes stand for, rounded away from zero; -1 where one ambiguous code holds the other."""
    a, b = set(_BASES[x]), set(_BASES[y])
    if min(len(a), len(b)) > 1 and (a <= b or b <= a):
        return -1
    same = len(a & b)
    mean = (_MATCH * same + _MISMATCH * (len(a) * len(b) - same)) / (len(a) * len(b))
    return int(math.copysign(math.floor(abs(mean) + 0.5), mean))


NUC44 = SubstMatrix([[_nucleotide(x, y) for y in IUPAC_DNA.symbols] for x in IUPAC_DNA.symbols], IUPAC_DNA.symbols)

# The lower triangle of BLOSUM62 over the twenty amino acids, in NCBI order.
_BLOSUM62_20 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def from_triangle(text: str) -> SubstMatrix:
    """A symmetric matrix from the rows of its lower triangle, each led by its symbol."""
    rows = [line.split() for line in text.strip().splitlines()]
    values = np.zeros((len(rows), len(rows)))
    for i, row in enumerate(rows):
        values[i, : i + 1] = values[: i + 1, i] = [float(x) for x in row[1:]]
    return SubstMatrix(values, "".join(r[0] for r in rows))


BLOSUM62_20 = from_triangle(_BLOSUM62_20)


def parse_ncbi(text: str, symbols: str | None = None) -> SubstMatrix:
    """A matrix in NCBI's format (comments, a line of symbols, a line a symbol), in the order of ``symbols`` or its own without ``*``."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    head, rows = lines[0], {x[0]: x[1:] for x in lines[1:]}
    symbols = symbols or "".join(c for c in head if c != "*" and c in rows)
    missing = [c for c in symbols if c not in rows or c not in head]
    if missing:
        raise ValueError(f"the matrix file has no {missing[0]!r}")
    return SubstMatrix([[float(rows[a][head.index(b)]) for b in symbols] for a in symbols], symbols)


def read_ncbi(spark: SparkSession, path: str, symbols: str | None = None) -> SubstMatrix:
    """Read BLOSUM, PAM, VTML or other NCBI-format matrix files through Spark's reader (a few KB each)."""
    return parse_ncbi(spark.read.text(path, wholetext=True).first()[0], symbols)


#: Protein matrices that are published in NCBI's format; each is a file of its own name.
PUBLISHED = ("BLOSUM45", "BLOSUM50", "BLOSUM62", "BLOSUM80", "BLOSUM90", "PAM30", "PAM70", "PAM250", "VTML40", "VTML80", "VTML160", "VTML200")


def load(spark: SparkSession, name: str, folder: str) -> SubstMatrix:
    """A published matrix by name, over the 23 letters of NCBI's order, from a folder of NCBI-format files; NUC44 needs none."""
    if name == "NUC44":
        return NUC44
    if name not in PUBLISHED:
        raise ValueError(f"unknown matrix {name!r}: expected NUC44 or one of {', '.join(PUBLISHED)}")
    return read_ncbi(spark, f"{folder.rstrip('/')}/{name}", NCBI_PROTEIN.symbols)
