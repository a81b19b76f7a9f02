"""Making pairs of sequences: joins that bound what is aligned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Parts into which the left rows of each key are dealt, so that no key is joined in one task; the right rows are repeated.
SALTS = 8
#: Parts of the subjects that words are looked up in; sequences of a chunk of subjects and of queries; words shared at a time.
SEED_SALTS, SUBJECTS, QUERIES, HITS = 64, 2048, 8192, 1 << 22


def _salted(a: DataFrame, b: DataFrame, on: list[str], by: str, salts: int) -> DataFrame:
    """The join of two frames on keys that few tasks would share.

    The pairs are far more than the rows, whose size says nothing of them: so the number of tasks is fixed here, or small
    inputs would be joined in one or two, and neither side is sent whole through the driver.
    """
    if a.isStreaming or b.isStreaming:
        return a.join(b, on)
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = list(on)
    if salts > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys).hint("merge"), keys).drop("_salt")


def block_pairs(rows: DataFrame, id_col: str, seq_col: str, *blocks: str, salts: int = SALTS, same: bool = False) -> DataFrame:
    """Every two rows of one block, once: id_a < id_b; with ``same`` each row with itself, too."""
    a = rows.select(*blocks, F.col(id_col).alias("id_a"), F.col(seq_col).alias("seq_a"))
    b = rows.select(*blocks, F.col(id_col).alias("id_b"), F.col(seq_col).alias("seq_b"))
    return _salted(a, b, list(blocks), "id_a", salts).where("id_a <= id_b" if same else "id_a < id_b")


def bipartite_pairs(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_seq: str, right_id: str, right_seq: str, salts: int = SALTS) -> DataFrame:
    """Every row of one table with every row of the other that shares the key."""
    a = left.select(*on, F.col(left_id).alias("id_a"), F.col(left_seq).alias("seq_a"))
    b = right.select(*on, F.col(right_id).alias("id_b"), F.col(right_seq).alias("seq_b"))
    return _salted(a, b, on, "id_a", salts)


def _word_numbers(left: pa.Array, right: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """(owners, words) of either list, sorted by owner: each distinct word of k residues that a sequence holds, as a number that is the word's alone."""
    texts = ["".join(x.to_pylist()) for x in (left, right)]
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letters, code = np.unique(flat, return_inverse=True)
    size = np.fromiter((len(s) for x in (left, right) for s in x.to_pylist()), np.int64, len(left) + len(right))
    owner = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero(np.arange(len(flat)) + k <= np.cumsum(size)[owner])  # words within one sequence
    word, kinds = np.zeros(len(start), np.int64), 1
    for x in range(k):
        if kinds > (1 << 62) // len(letters):  # too many to tell apart by place: the words so far are numbered
            found, word = np.unique(word, return_inverse=True)
            kinds = len(found)
        word, kinds = word * len(letters) + code[start + x], kinds * len(letters)
    owner = owner[start]
    order = np.lexsort((word, owner))
    owner, word = owner[order], word[order]
    once = np.ones(len(word), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
    owner, word = owner[once], word[once]
    cut = int(np.searchsorted(owner, len(left)))
    return owner[:cut], word[:cut], owner[cut:] - len(left), word[cut:]


def _shared_words(left: pa.Array, right: pa.Array, k: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``left``, in ``right``, distinct words of k residues that both hold), of pairs that share ``least`` or more."""
    of_a, word_a, of_b, word_b = _word_numbers(left, right, k)
    order = np.argsort(word_b, kind="stable")
    of_b, word_b = of_b[order], word_b[order]
    low, high = np.searchsorted(word_b, word_a, "left"), np.searchsorted(word_b, word_a, "right")
    ends = np.flatnonzero(np.diff(of_a, append=-1)) + 1  # a sequence's words are counted together
    total, x = np.cumsum(high - low), 0
    while x < len(of_a):
        past = int(total[x - 1]) if x else 0
        done = ends[(ends > x) & (total[ends - 1] <= past + HITS)]
        y = int(done[-1]) if len(done) else int(ends[np.searchsorted(ends, x, "right")])
        n = (high - low)[x:y]
        at = np.repeat(low[x:y] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, shared = np.unique(np.repeat(of_a[x:y], n) * len(right) + of_b[at], return_counts=True)
        pair, shared = pair[shared >= least], shared[shared >= least]
        yield pair // len(right), pair % len(right), shared
        x = y


def seed_counts(queries: DataFrame, subjects: DataFrame, k: int, id_col: str, seq_col: str, least: int = 1, salts: int = SEED_SALTS) -> DataFrame:
    """(id_a, id_b, shared): queries and subjects that share at least ``least`` distinct words of k residues; ids name one row each.

    Words are looked up where chunks of queries and of subjects meet, so that a shared word is never a row and no pair is
    shuffled.  Chunks of subjects are dealt over ``salts`` parts; the queries are repeated for each.
    Null and shorter sequences have no words.
    """

    def chunks(df: DataFrame, name: str, most: int) -> DataFrame:
        rows = df.where(F.length(seq_col) >= k).select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"))
        parts = max(1, -(-rows.count() // most))
        lists = rows.groupBy(F.pmod(F.xxhash64("id", "seq"), F.lit(parts)).alias(f"part_{name}")).agg(F.collect_list(F.struct("id", "seq")).alias("x"))
        return lists.select(F.lit(0).alias("all"), f"part_{name}", F.col("x.id").alias(f"ids_{name}"), F.col("x.seq").alias(f"seqs_{name}"))

    tasks = subjects.sparkSession.sparkContext.defaultParallelism * 4
    fewer = lambda df, most: max(64, min(most, -(-df.count() // tasks)))
    met = _salted(chunks(subjects, "b", fewer(subjects, SUBJECTS)), chunks(queries, "a", QUERIES), ["all"], "part_b", salts).select("ids_a", "seqs_a", "ids_b", "seqs_b")
    kind = queries.schema[id_col].dataType.simpleString(), subjects.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids_a, seqs_a, ids_b, seqs_b = (c.flatten() for c in batch.slice(row, 1).columns)
                for a, b, shared in _shared_words(seqs_a, seqs_b, k, least):
                    yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(a)), ids_b.take(pa.array(b)), pa.array(shared.astype(np.int64))], names=["id_a", "id_b", "shared"])

    return met.mapInArrow(run, f"id_a {kind[0]}, id_b {kind[1]}, shared long").where("id_a != id_b")


def seed_pairs(queries: DataFrame, subjects: DataFrame, k: int, id_col: str, seq_col: str, least: int = 1, salts: int = SEED_SALTS) -> DataFrame:
    """A stated set of queries against all subjects that share words (:func:`seed_counts`), with their sequences.

    An all-against-all without pairs that cannot score: it is made of words, not of everything.
    """
    hits = seed_counts(queries, subjects, k, id_col, seq_col, least, salts)
    return (
        hits.join(queries.select(F.col(id_col).alias("id_a"), F.col(seq_col).alias("seq_a")).hint("merge"), "id_a")
        .join(subjects.select(F.col(id_col).alias("id_b"), F.col(seq_col).alias("seq_b")).hint("merge"), "id_b")
        .select("id_a", "id_b", "shared", "seq_a", "seq_b")
    )


def pending_pairs(pairs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The pairs that have no result yet."""
    return pairs.join(done.select(*keys), list(keys), "left_anti")


def best_hits(scored: DataFrame, query: str, k: int, *ties: str) -> DataFrame:
    """The k best-scored rows of each query.

    Spark keeps k rows a query and task before it shuffles (a window group limit), so a query that
    meets a third of all rows sends k rows a task.
    """
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), *ties))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def dna_of(key: Column) -> Column:
    """A DNA sequence of 32 letters derived from a key."""
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
