import hashlib
import pickle

import numpy as np
import pytest

import alignspark
from alignspark import DNA, AlignParams, Alphabet, SubstMatrix
from alignspark.functions import oneoff
from alignspark.matrices import BLOSUM62_20, NUC44, parse_ncbi


def test_alphabets():
    assert Alphabet.get("ACGT") is DNA and pickle.loads(pickle.dumps(DNA)) is DNA
    assert len(DNA) == DNA.size == 4 and DNA.index_of("G") == 2 and DNA.index_of("x") == -1 and DNA.contains("A")
    assert DNA.decode(DNA.encode("GATTACA")) == "GATTACA"
    for bad in ("", "A-C", "AA", "é", "".join(map(chr, range(128)))):
        with pytest.raises(ValueError):
            Alphabet(bad)
    with pytest.raises(ValueError, match="'d' .0x64. at position 2"):
        DNA.encode("ACd")


def test_parameters():
    p = AlignParams(SubstMatrix(np.eye(4), "ACGT"), 1, 2, 3, 4)
    q = p + 0.5 * p
    assert q.gap_extend_b == 6 and q.matrix.score("A", "A") == 1.5 and (-q - q).gap_open_a == -3
    p2 = p.copy()
    p2 += p
    assert p2.gap_open_a == 2 and p.gap_open_a == 1
    k = AlignParams.stack([p, q])
    assert k.num_sets == 2 and k[1].gap_extend_b == 6 and k.to_dict()["num_sets"] == 2 and "matrices" not in p.to_dict()
    k[0] = q
    assert k.gaps[0].tolist() == q.gaps[0].tolist() and k.like_flat(k.flat()).dot(k) == k.dot(k)
    k.zero()
    assert not k.flat().any() and not p.zeros_like().flat().any()
    for wrong in (lambda: p + k, lambda: p + AlignParams(np.eye(20)), lambda: SubstMatrix(np.eye(3), "ACGT"), lambda: SubstMatrix(np.zeros((4, 3)), "ACGT"), lambda: AlignParams.from_arrays(np.zeros((2, 4, 4)), np.zeros((1, 4)), "ACGT")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(IndexError):
        k[2]


def test_matrices():
    values = np.ascontiguousarray(NUC44.to_matrix(), dtype="<f8")
    # fixed value: digest of the published table
    assert hashlib.sha256(NUC44.alphabet.encode() + b"\0" + values.tobytes()).hexdigest() == "069c6bd85045b38bf9666da88a60742b6089a551bb1fba8461bad4d02d2d7386"
    assert (BLOSUM62_20.values == BLOSUM62_20.values.T).all() and BLOSUM62_20.score("W", "W") == 11
    text = "# comment\n   A  B  *\nA  1 -2 -9\nB -2  3 -9\n* -9 -9  1\n"
    m = parse_ncbi(text)
    assert m.alphabet == "AB" and m.score("A", "B") == -2 and parse_ncbi(text, "BA").values.tolist() == [[3, -2], [-2, 1]]
    with pytest.raises(ValueError):
        parse_ncbi(text, "AC")


def test_one_off_functions():
    assert len(oneoff.NAMES) == 84
    p = AlignParams(SubstMatrix(4 * np.eye(4) - 2, "ACGT"), 3, 1, 3, 1)
    score, grad = oneoff.nw_affine_grad_double("ACGTT", "AGTT", p)
    assert score == oneoff.nw_score_affine_int16("ACGTT", "AGTT", p) == grad.dot(p)
    assert oneoff.sw_score("ACGT", "ACGT", p) == 8 and oneoff.glocal_score("CG", "ACGT", p) == 4
    z, counts = oneoff.nw_affine_soft_grad("ACGT", "ACG", p, temperature=2.0)
    assert z > score - 20 and counts.gap_extend_a <= 0
    assert oneoff.nw_score("ACGT", "ACG", p, 1, "ACGT", "ACG-") == oneoff.nw_score("ACGT", "ACG", p)
    assert oneoff.guide_j_from_aligned("AC-GT", "A-TGT") == [0, 1, 1, 3, 4]
    for wrong in (lambda: oneoff.nw_score("AC", "N", p), lambda: oneoff.nw_score("A", "A", p, 0, "A", ""), lambda: oneoff.nw_score("A", "A", p, -1), lambda: oneoff.nw_score("A", "A", p, kernel="fast"), lambda: oneoff.guide_j_from_aligned("-", "-"), lambda: oneoff.nw_score("AC", "AC", p, 1, "A-", "AC")):
        with pytest.raises(ValueError):
            wrong()
    assert alignspark.__version__
