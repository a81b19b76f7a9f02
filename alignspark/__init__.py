"""Differentiable pairwise sequence alignment on Spark DataFrames."""

from alignspark.alphabet import DNA, DNA_N, IUPAC_DNA, NCBI_PROTEIN, PROTEIN, PROTEIN_UO, PROTEIN_UOX, PROTEIN_X, RNA, RNA_N, Alphabet
from alignspark.params import AlignParams, SubstMatrix

__version__ = "0.1.0"
__all__ = ["DNA", "DNA_N", "IUPAC_DNA", "NCBI_PROTEIN", "PROTEIN", "PROTEIN_UO", "PROTEIN_UOX", "PROTEIN_X", "RNA", "RNA_N", "AlignParams", "Alphabet", "SubstMatrix"]
