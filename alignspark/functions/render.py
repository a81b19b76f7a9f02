"""Views of an alignment as Column expressions over its path (ops, start_i, start_j) and its sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _piece(seq: Column, at: Column, n: Column) -> Column:
    return F.substring(seq, at + 1, n)


def aligned(seq_a: Column, seq_b: Column, ops: Column, start_i: Column, start_j: Column) -> Column:
    """struct<a, b>: the two gapped strings."""
    state = lambda i, j, a, b: F.struct(i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b"))

    def step(acc: Column, x: Column) -> Column:
        n, gap = x["len"], F.repeat(F.lit("-"), x["len"])
        return state(
            acc["i"] + F.when(x["op"] != 2, n).otherwise(0), acc["j"] + F.when(x["op"] != 1, n).otherwise(0),
            F.concat(acc["a"], F.when(x["op"] != 2, _piece(seq_a, acc["i"], n)).otherwise(gap)),
            F.concat(acc["b"], F.when(x["op"] != 1, _piece(seq_b, acc["j"], n)).otherwise(gap)),
        )

    zero = state(start_i.cast("int"), start_j.cast("int"), F.lit(""), F.lit(""))
    return F.aggregate(ops, zero, step, lambda acc: F.struct(acc["a"].alias("a"), acc["b"].alias("b")))


def coordinates(ops: Column, start_i: Column, start_j: Column) -> Column:
    """struct<a, b>: positions at the start, after each run, and at the end."""

    def along(start: Column, skip: int) -> Column:
        ends = F.aggregate(
            ops, F.array(start.cast("bigint")),
            lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.when(x["op"] != skip, x["len"]).otherwise(0)),
        )
        return F.when(F.size(ops) == 0, F.array(start.cast("bigint"), start.cast("bigint"))).otherwise(ends)

    return F.struct(along(start_i, 2).alias("a"), along(start_j, 1).alias("b"))


def index_pairs(ops: Column, start_i: Column, start_j: Column) -> Column:
    """array<struct<i, j>>: the positions that are aligned with each other."""
    xy = coordinates(ops, start_i, start_j)
    runs = F.filter(F.zip_with(ops, F.sequence(F.lit(0), F.greatest(F.size(ops) - 1, F.lit(0))), lambda x, k: F.struct(x["op"].alias("op"), x["len"].alias("len"), k.alias("k"))), lambda r: r["op"] == 0)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(0), r["len"] - 1), lambda d: F.struct((F.get(xy["a"], r["k"]) + d).alias("i"), (F.get(xy["b"], r["k"]) + d).alias("j")))))


def _columns(al: Column, classify) -> Column:
    """A string with one character a column of an alignment."""
    n = F.length(al["a"])
    cols = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: classify(F.substring(al["a"], k, F.lit(1)), F.substring(al["b"], k, F.lit(1))))
    return F.when(n == 0, "").otherwise(F.array_join(cols, ""))


def cigar(seq_a: Column, seq_b: Column, ops: Column, start_i: Column, start_j: Column, extended: bool = False, soft_clip: bool = False) -> Column:
    """SAM CIGAR with ``seq_a`` as the query: M (or = and X), I against a gap in B, D against a gap in A, S clipped."""
    if extended:
        marks = _columns(aligned(seq_a, seq_b, ops, start_i, start_j), lambda a, b: F.when(a == "-", "D").when(b == "-", "I").when(a == b, "=").otherwise("X"))
        runs = F.transform(F.regexp_extract_all(marks, F.lit(r"(.)\1*"), F.lit(0)), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1)))
    else:
        runs = F.transform(ops, lambda x: F.concat(x["len"].cast("string"), F.when(x["op"] == 0, "M").when(x["op"] == 1, "I").otherwise("D")))
    text = F.array_join(runs, "")
    if not soft_clip:
        return text
    used = F.aggregate(ops, F.lit(0), lambda acc, x: acc + F.when(x["op"] != 2, x["len"]).otherwise(0))
    tail = F.length(seq_a) - start_i - used
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    # an empty local alignment clips the whole query in one run
    return F.when(F.size(ops) == 0, clip(F.length(seq_a))).otherwise(F.concat(clip(start_i), text, clip(tail)))


def formatted(al: Column, width: int = 60) -> Column:
    """Three lines a block - A, ``|`` equal ``.`` unequal, B - wrapped at ``width`` columns (0: not)."""
    marks = _columns(al, lambda a, b: F.when((a == "-") | (b == "-"), " ").when(a == b, "|").otherwise("."))
    n = F.length(al["a"])
    w = F.lit(width) if width > 0 else F.greatest(n, F.lit(1))
    block = lambda c: F.concat_ws("\n", *(F.substring(x, (c * w + 1).cast("int"), w) for x in (al["a"], marks, al["b"])))
    return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), (F.ceil(n / w) - 1).cast("int")), block), "\n\n"))


def guide_from_aligned(a_al: Column, b_al: Column) -> Column:
    """The column after each residue of A, from two gapped strings."""
    n = F.length(a_al)
    spots = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    is_gap = lambda s, k: F.substring(s, k, F.lit(1)) == "-"
    taken = F.filter(spots, lambda k: ~is_gap(a_al, k))
    guide = F.concat(F.array(F.lit(0)), F.transform(taken, lambda k: F.length(F.replace(F.substring(b_al, F.lit(1), k), F.lit("-"), F.lit("")))))
    both = F.exists(spots, lambda k: is_gap(a_al, k) & is_gap(b_al, k))
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<int>")
    return F.when(n != F.length(b_al), fail("aligned strings must have equal length")).when(both, fail("aligned strings have a column with two gaps")).otherwise(guide)


def valid_guide(guide: Column, m: Column, n: Column) -> Column:
    """Whether a guide has m + 1 entries within 0..n that never fall."""
    pairs = F.zip_with(F.slice(guide, 1, F.greatest(F.size(guide) - 1, F.lit(0))), F.slice(guide, 2, F.greatest(F.size(guide) - 1, F.lit(0))), lambda a, b: a <= b)
    return (F.size(guide) == m + 1) & F.forall(guide, lambda g: (g >= 0) & (g <= n)) & F.forall(pairs, lambda ok: ok)
