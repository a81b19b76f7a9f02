"""Whole cross products: sequences that share a key, in chunks, every chunk of one side against every chunk of the other.

A pair costs no row: what is read is a chunk's letters, and what comes back is
counted by score, a row a score and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.operators.align import Problem, encode_all
from alignspark.operators.pairs import _salted
from alignspark.params import AlignParams
from alignspark.plans.crossed import Crossed

#: Sequences of a chunk on the left and on the right, or so.
LEFT, RIGHT = 256, 1024
#: Parts into which the left chunks of a key are dealt.
SALTS = 32
#: Numbers that a chunk of named sequences spans; pairs that are scored at once.
SPAN, AT_ONCE = 1 << 15, 1 << 21


def chunked(rows: DataFrame, seq_col: str, *keys: str, size: int, number: str | None = None) -> DataFrame:
    """(keys ..., length, seqs): sequences of one length that have the same keys, some ``size`` at most in a list; with ``number`` also ids, that column's."""
    seq = F.coalesce(F.col(seq_col), F.raise_error(F.lit(f"{seq_col} is null")).cast("string"))
    rows = rows.select(*keys, seq.alias("seq"), *([F.col(number).cast("bigint").alias("id")] if number else [])).withColumn("length", F.length("seq"))
    by = [*keys, "length"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    part = F.pmod(F.xxhash64("seq"), F.ceil(F.col("_n") / size))
    chunks = rows.join(sizes, same).groupBy(*by, part.alias("part"))
    if number is None:
        return chunks.agg(F.collect_list("seq").alias("seqs"))
    return chunks.agg(F.collect_list(F.struct("id", "seq")).alias("x")).select(*by, "part", F.col("x.seq").alias("seqs"), F.col("x.id").alias("ids"))


def crossed(left: DataFrame, right: DataFrame, on: list[str], left_seq: str, right_seq: str, keep: tuple[str, ...] = (), salts: int = SALTS) -> DataFrame:
    """(on ..., keep ..., seqs_a, seqs_b): all pairs of rows that share ``on``, as pairs of chunks; ``keep`` are columns of the left."""
    a = chunked(left, left_seq, *on, *keep, size=LEFT).withColumnRenamed("seqs", "seqs_a").drop("length", "part")
    b = chunked(right, right_seq, *on, size=RIGHT).withColumnRenamed("seqs", "seqs_b").drop("length", "part")
    return _salted(a, b, on, "seqs_a", salts)


def crossed_numbered(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_seq: str, right_id: str, right_seq: str, salts: int = SALTS) -> DataFrame:
    """(on ..., seqs_a, ids_a, seqs_b, ids_b): as :func:`crossed`, with a number for each sequence; a pair's id is the sum of its two."""
    a = chunked(left, left_seq, *on, size=LEFT, number=left_id).withColumnsRenamed({"seqs": "seqs_a", "ids": "ids_a"}).drop("length", "part")
    b = chunked(right, right_seq, *on, size=RIGHT, number=right_id).withColumnsRenamed({"seqs": "seqs_b", "ids": "ids_b"}).drop("length", "part")
    return _salted(a, b, on, "seqs_a", salts)


def crossed_named(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_seq: str, right_seq: str, offset: str, names: DataFrame, name_id: str, name: str) -> DataFrame:
    """(on ..., seqs_a, ids_a, seqs_b, offsets, names): as :func:`crossed`; a pair is named by the rows of ``names`` whose id is ``left_id`` plus ``offset``.

    A left chunk has ids of one span and comes with the names of the one or two spans that its pairs name, so that
    neither pairs nor a row's ids for all offsets are rows.  Rows without id, offset or key are in no pair.
    """
    text = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")).cast("string"))
    span = lambda c: F.floor(F.col(c) / F.lit(SPAN)).cast("bigint")
    left = left.where(F.col(left_id).isNotNull()).select(*on, span(left_id).alias("_at"), F.col(left_id).cast("bigint").alias("id"), text(left_seq).alias("seq"))
    a = left.groupBy(*on, "_at", F.length("seq")).agg(F.collect_list(F.struct("id", "seq")).alias("a")).select(*on, "_at", F.col("a.seq").alias("seqs_a"), F.col("a.id").alias("ids_a"))
    right = right.where(F.col(offset).isNotNull()).select(*on, span(offset).alias("_by"), F.col(offset).cast("bigint").alias("offset"), text(right_seq).alias("seq"), F.length(right_seq).alias("length"))
    sizes = right.groupBy(*on, "_by", "length").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("seq"), F.ceil(F.col("_n") / RIGHT))
    b = right.join(sizes, [*on, "_by", "length"]).groupBy(*on, "_by", "length", part.alias("part")).agg(F.collect_list(F.struct("offset", "seq")).alias("b"))
    b = b.select(*on, "_by", F.col("b.seq").alias("seqs_b"), F.col("b.offset").alias("offsets"))
    reach = right.groupBy(*on, "_by").agg(F.max(F.pmod("offset", F.lit(SPAN))).alias("_reach"))
    names = names.where(F.col(name_id).isNotNull()).select(span(name_id).alias("_span"), F.struct(F.col(name_id).cast("bigint").alias("id"), F.col(name).alias("name")).alias("x"))
    names = names.groupBy("_span").agg(F.collect_list("x").alias("_names")).hint("merge")
    a = a.join(reach, on)
    first = F.col("_at") + F.col("_by")
    a = a.withColumn("_first", first).join(names.withColumnsRenamed({"_span": "_first", "_names": "_low"}), "_first", "left")
    a = a.withColumn("_next", F.when(F.col("_reach") > 0, F.col("_first") + 1)).join(names.withColumnsRenamed({"_span": "_next", "_names": "_high"}), "_next", "left")
    a = a.where("_low is not null or _high is not null").withColumn("names", F.concat(F.coalesce("_low", F.array()), F.coalesce("_high", F.array())))
    return _salted(a.select(*on, "_by", "seqs_a", "ids_a", "names"), b, [*on, "_by"], "seqs_a", SALTS).drop("_by")


def _codes(lists: pa.ListArray, params: AlignParams, which: str) -> list[np.ndarray]:
    """The letters' codes of each list, a row a sequence."""
    texts = lists.flatten()
    found, wrong = encode_all(texts, params, which)
    if wrong:
        raise ValueError(f"{texts[min(wrong)].as_py()!r}{wrong[min(wrong)]}")
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
    return [np.stack(found[x:y]) for x, y in zip(edges, edges[1:])]


def _counted(scores: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """(each score, how often it is there); all are multiples of ``unit``."""
    least = int(scores.min())
    if (int(scores.max()) - least) // unit > 2 * scores.size:
        return np.unique(scores, return_counts=True)
    n = np.bincount((scores.ravel() - least) // unit)
    at = np.flatnonzero(n)
    return least + at * unit, n[at]


def _by_name(s: Crossed, a: np.ndarray, ids: np.ndarray, b: np.ndarray, offsets: np.ndarray, named: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, score, pairs): ``codes`` are those of the ids ``named``; a pair counts once for each that has its id."""
    order = np.argsort(offsets, kind="stable")
    b, offsets, edges = b[order], offsets[order], np.flatnonzero(np.diff(offsets[order], prepend=offsets[order[0]] - 1)).tolist()
    order = np.argsort(named, kind="stable")
    named, codes = named[order], codes[order]
    parts = []
    step = max(1, AT_ONCE // len(b))
    for k in range(0, len(a), step):
        some = ids[k : k + step]
        found = [(y - x, np.searchsorted(named, some + offsets[x], "left"), np.searchsorted(named, some + offsets[x], "right")) for x, y in zip(edges, [*edges[1:], len(b)])]
        # Only offsets and sequences that name something are aligned.
        used = np.array([(low < high).any() for _, low, high in found])
        if not used.any():
            continue
        found = [x for x, y in zip(found, used) if y]
        rows = np.flatnonzero(np.any([low < high for _, low, high in found], axis=0))
        scores = s.scores(a[k : k + step][rows], b[np.repeat(used, np.diff([*edges, len(b)]))])
        least = int(scores.min())
        if (int(scores.max()) - least) // s.unit > 2 * len(b):
            kinds, at = np.unique(scores, return_inverse=True)
            scores = at.reshape(scores.shape)
        else:
            kinds, scores = np.arange(least, int(scores.max()) + 1, s.unit), (scores - least) // s.unit
        scores += len(kinds) * np.arange(len(rows))[:, None]
        sums = np.zeros((int(codes.max()) + 1, len(kinds)), np.int64)
        x = 0
        for wide, low, high in found:
            each = np.bincount(scores[:, x : x + wide].ravel(), minlength=len(rows) * len(kinds)).reshape(-1, len(kinds))
            x, low, n = x + wide, low[rows], (high - low)[rows]
            row = np.repeat(np.arange(len(rows)), n)
            np.add.at(sums, codes[low[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]], each[row])
        code, kind = np.nonzero(sums)
        parts.append((code, kinds[kind], sums[code, kind]))
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 3


def _named_counts(blocks: DataFrame, params: AlignParams, problem: Problem, name: str) -> DataFrame:
    src = blocks.select("seqs_a", "seqs_b", "ids_a", "offsets", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple[int, int], Crossed] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                a, b = (_codes(one.column(x), params, which)[0] for x, which in enumerate(("seq_a", "seq_b")))
                ids, offsets = (one.column(x).flatten().to_numpy() for x in (2, 3))
                named, names = one.column(4).flatten().flatten()
                names = names.dictionary_encode(null_encoding="encode")
                lengths = a.shape[1], b.shape[1]
                if lengths not in last:
                    last.clear()
                    last[lengths] = Crossed(problem.scoring(params), *lengths)
                code, score, n = _by_name(last[lengths], a, ids, b, offsets, named.to_numpy(), names.indices.to_numpy())
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code)), pa.array(score.astype(np.float64)), pa.array(n)], names=[name, "score", "n"])

    kind = src.schema["names"].dataType.elementType["name"].dataType.simpleString()
    return src.mapInArrow(run, f"`{name}` {kind}, score double, n long").groupBy(name, "score").agg(F.sum("n").alias("n"))


def score_counts(blocks: DataFrame, params: AlignParams, problem: Problem = Problem(), keep: tuple[str, ...] = (), name: str | None = None) -> DataFrame:
    """(keep ..., score, n): how many pairs of the cross products have a score.

    Parameters must be integral, gap costs not negative; sequences may have any lengths, equal ones share a chunk.
    With a gradient (grad "hard") there are also field and value, the gradient summed over the pairs of a score, a row
    a field that it touches; the number of pairs is in the row without a field, and n is 0 in the others.
    With ``name``, the blocks are those of :func:`crossed_named`, and the result is (name, score, n).
    """
    problem.check(params)
    if problem.band or problem.grad == "soft":
        raise ValueError("cross products have best scores without a band only")
    if name is not None:
        if keep or problem.grad != "none":
            raise ValueError("named cross products keep nothing else and have no gradient")
        return _named_counts(blocks, params, problem, name)
    src, graded = blocks.select(*keep, "seqs_a", "seqs_b"), problem.grad == "hard"
    names = [*keep, "score", "n", *(("field", "value") if graded else ())]

    def found(a: np.ndarray, b: np.ndarray, last: dict) -> tuple[np.ndarray, ...]:
        lengths = a.shape[1], b.shape[1]
        if lengths not in last:
            last.clear()
            last[lengths] = Crossed(problem.scoring(params), *lengths)
        s = last[lengths]
        if not graded:
            return _counted(s.scores(a, b), s.unit)
        score, n, sums = s.path_sums(a, b)
        k, field = np.nonzero(sums)
        return tuple(map(np.concatenate, ((score, score[k]), (n, np.zeros_like(k)), (np.full(len(n), -1), field), (np.zeros(len(n)), sums[k, field]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple[int, int], Crossed] = {}
        for batch in batches:
            left, right = (_codes(batch.column(len(keep) + k), params, which) for k, which in enumerate(("seq_a", "seq_b")))
            parts = [found(a, b, last) for a, b in zip(left, right, strict=True)]
            at = pa.array(np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts]))
            score, n, *more = map(np.concatenate, zip(*parts, strict=True))
            cols = [pa.array(score.astype(np.float64)), pa.array(n)]
            if graded:
                cols += [pa.array(more[0].astype(np.int32), mask=more[0] < 0), pa.array(more[1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), *cols], names=names)

    schema = [*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), "score double", "n long", *(("field int", "value double") if graded else ())]
    rows = src.mapInArrow(run, ", ".join(schema))
    if graded:
        return rows.groupBy(*keep, "score", "field").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).select(*names)
    return rows.groupBy(*keep, "score").agg(F.sum("n").alias("n"))


def _numbers(ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """The ids of all pairs, a row for each of ``ids_a``."""
    if len(ids_a) and len(ids_b) and max(abs(int(ids_a.min()) + int(ids_b.min())), abs(int(ids_a.max()) + int(ids_b.max()))) > np.iinfo(np.int64).max:
        raise OverflowError("a pair's id is beyond 64 bits")
    return ids_a[:, None] + ids_b


def cross_align(blocks: DataFrame, id_col: str = "pair_id", best: tuple[int, int] | None = None, **problems: tuple) -> DataFrame:
    """(id, a column for each of ``problems``: parameters and problem): scores of all pairs of the blocks of :func:`crossed_numbered`.

    A third entry has the parameters under which best local paths are the guides of the problem's band.
    A pair is a row from here on only; a null number gives a null id.  Parameters as in :func:`score_counts`; bands are
    those of the main diagonal.  Of a problem with a gradient (grad "hard") the column is each pair's gradient times the
    parameters, not the score of the fill.  ``best`` (k, per) leaves out pairs that k others of the same id // per beat
    by the first column: those left hold the k best of each, whatever breaks ties.
    """
    for params, p, *around in problems.values():
        for x in (params, *around):
            p.check(x)
        if around and not (p.band and p.mode == "local"):
            raise ValueError("guides need a band and local mode")
        if p.grad == "soft" or p.band and p.grad != "none":
            raise ValueError("cross products have best scores, and gradients of best paths without a band")
    src = blocks.select("seqs_a", "seqs_b", "ids_a", "ids_b")
    letters = next(iter(problems.values()))[0]
    if any(x.alphabet != letters.alphabet for params, _, *around in problems.values() for x in (params, *around)):
        raise ValueError("all parameters need one alphabet")
    names = [id_col, *problems]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple, Crossed] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                a, b = (_codes(one.column(x), letters, which)[0] for x, which in enumerate(("seq_a", "seq_b")))
                (ids_a, none_a), (ids_b, none_b) = ((x.fill_null(0).to_numpy(), x.is_null().to_numpy(zero_copy_only=False)) for x in (one.column(c).flatten() for c in (2, 3)))
                lengths = a.shape[1], b.shape[1]
                if (lengths, names[1]) not in last:
                    last = {(lengths, name): Crossed(p.scoring(params), *lengths, p.band) for name, (params, p, *_) in problems.items()}
                    last |= {(lengths, name, "guide"): Crossed(p.scoring(around[0]), *lengths) for name, (_, p, *around) in problems.items() if around}
                found = []
                for name, (params, p, *around) in problems.items():
                    s = last[lengths, name]
                    if around:
                        found.append(s.scores_around(a, b, last[lengths, name, "guide"].guides(a, b)))
                    else:
                        found.append(s.path_dots(a, b, params.flat()) if p.grad == "hard" else s.scores(a, b))
                ids = _numbers(ids_a, ids_b)
                keep = _near_best(found[0], ids_a, ids_b, *best) if best else None
                cols = [x.ravel() if keep is None else x[keep] for x in (ids, *found)]
                none = none_a[:, None] | none_b
                mask = (none.ravel() if keep is None else none[keep]) if none.any() else None
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], mask=mask), *(pa.array(x.astype(np.float64)) for x in cols[1:])], names=names)

    return src.mapInArrow(run, ", ".join([f"`{id_col}` long", *(f"`{x}` double" for x in problems)]))


def _near_best(scores: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, k: int, per: int) -> np.ndarray:
    """Which pairs are not beaten by k others of the same id // per in their row; of numbers that are no multiples of ``per``, all."""
    keep = np.ones(scores.shape, bool)
    if not (ids_a % per).any():
        kinds, of = np.unique(ids_b // per, return_inverse=True)
        for x in range(len(kinds)):
            at = np.flatnonzero(of == x)
            if len(at) > k:
                part = scores[:, at] if len(kinds) > 1 else scores
                keep[:, at] = part >= np.partition(part, -k, axis=1)[:, [-k]]
    return keep
