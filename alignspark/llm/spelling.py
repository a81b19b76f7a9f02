"""Spelling variants: words that differ by one code point, found by two-dimensional range reporting.

Words that begin alike are neighbours in forward order, words that end alike in
the order of their reversed forms.  A word and an edit position fix a prefix and
a suffix: an interval in each order.  The words in both intervals are those that
differ from it at that position.  Words are points (place in forward order,
place in reverse order); a wavelet tree over the reverse places, in forward
order, reports the points of a rectangle.

One edit leaves the first or the second half of a word untouched.  So words are
dealt out by (length of the longer word, untouched half), and each task builds
trees over its own words alone and looks for edits in the other half.  A half
that more than ``GROUP`` words share is split before: the free part is cut in
two, and words that share what is then untouched on both sides go together.
When one code point is free, a group holds as many words as the alphabet has
letters.  Tasks keep of each word the number of near words and the best one.

An inserted code point that equals its left neighbour could stand before it as
well; only the leftmost place counts, so each two near words meet exactly once.

Words come from texts by built-in functions, one occurrence a row, counted
before they are shuffled.

Defined results: null and empty texts have no words; a null id counts as an
empty string in the hash; rows that share an id count for themselves; no words,
no rows; other columns are ignored; a word of any length is compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.llm.common import drop_table, materialize

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Every so many word occurrences one loses a code point.
DAMAGE = 31
#: A form occurs this many times as often as its variant.
RATIO = 10
#: Words of one untouched part beyond which it is split.
GROUP = 20_000
#: Letters of the words of one task (each word is dealt out four times).
TASK_LETTERS = 1_000_000
#: Rectangles that are followed down the tree at a time.
STEP = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def damaged_words(documents: DataFrame) -> DataFrame:
    """(word): every run of letters, in lower case; every 31st, by a hash of id and word, lacks one code point."""
    # a run that is too short stays so
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"),
    )
    lowered = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _UPPER.lower())).otherwise(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % DAMAGE == 0, lost).otherwise(F.col("run")).alias("word"))


def counted_words(documents: DataFrame) -> DataFrame:
    """(word, n): the words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more."""
    words = damaged_words(documents).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def _keyed(rows: DataFrame) -> DataFrame:
    """With ``key``: a hash of the longer length and of what is untouched outside ``first`` to ``last``."""
    tail = F.col("longer") - F.col("last")
    suffix = F.substring("word", F.char_length("word") - tail + 1, tail)
    return rows.withColumn("key", F.xxhash64("longer", "first", "last", F.substring("word", F.lit(1), F.col("first")), suffix))


def dealt(words: DataFrame, group: int | None = None) -> DataFrame:
    """(longer, first, last, word, n, key): where each word is compared; near words share a key for exactly one place of the edit.

    ``longer`` is the length of the longer of two words, ``first`` to ``last`` the places of its edit.
    """
    group = group or GROUP
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"))
    half = F.floor(F.col("longer") / 2).cast("int")
    part = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    rows = _keyed(rows.select("word", "n", "longer", F.explode(F.array(part(F.lit(0), half), part(half, F.col("longer")))).alias("p")).select("longer", "p.first", "p.last", "word", "n"))
    done = None
    while True:
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("last") - F.col("first")).alias("free")).where((F.col("size") > group) & (F.col("free") > 1)).select("key")
        large = materialize(large, "large-parts")
        if large.isEmpty():
            drop_table(large)
            return rows if done is None else done.unionByName(rows)
        # at most rows / GROUP keys
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("first") + F.col("last")) / 2)
        split = rows.join(large, "key", "left_semi").withColumn("p", F.explode(F.array(part(F.col("first"), middle), part(middle, F.col("last")))))
        rows = materialize(_keyed(split.select("longer", "p.first", "p.last", "word", "n")), "split-parts")


class WaveletTree:
    """A permutation in levels of bits, high ones first; each level sorts stably by its bit."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        now = values.astype(np.int64)
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all values in [low, high) at places [left, right) of each rectangle."""
        which, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for k, zeros in enumerate(self.zeros):
            rest = self.depth - 1 - k
            a, b, total = zeros[left], zeros[right], zeros[-1]
            which, left, right = np.concatenate([which, which]), np.concatenate([a, total + left - a]), np.concatenate([b, total + right - b])
            value = np.concatenate([2 * value, 2 * value + 1])
            # a child that is not empty and whose values meet the rectangle's
            keep = (left < right) & ((value << rest) < high[which]) & ((value + 1 << rest) > low[which])
            which, left, right, value = which[keep], left[keep], right[keep], value[keep]
        return which, value


def _shared(ordered: np.ndarray) -> np.ndarray:
    """How many first letters each row shares with the one before it; of the first, none."""
    out = np.zeros(len(ordered), np.int64)
    other = ordered[1:] != ordered[:-1]
    out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), ordered.shape[1])
    return out


def _intervals(order: np.ndarray, shared: np.ndarray, points: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, between which points those lie that share its first ``length`` letters; ``points`` counts them along the order."""
    new = shared < length
    new[0] = True
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low, high = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    low[order], high[order] = points[starts][group], points[np.append(starts[1:], len(order))][group]
    return low, high


def near_in_group(words: list[bytes], longer: int, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, near word) by number: words of length ``longer`` or one less that differ at a place from ``first`` to ``last``.

    Two words of one length are found from both, a longer one from the shorter alone.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    is_point = size == longer
    points = np.flatnonzero(is_point)
    if not len(points) or len(words) < 2:
        return
    forward = np.array(words, f"S{longer}")
    letters = forward.view(np.uint8).reshape(len(words), longer)
    backward = np.array([w[::-1] for w in words], f"S{longer}")
    mirrored = backward.view(np.uint8).reshape(len(words), longer)
    order, reverse = np.argsort(forward, kind="stable"), np.argsort(backward, kind="stable")
    by_reverse = reverse[is_point[reverse]]
    place = np.empty(len(words), np.int64)
    place[by_reverse] = np.arange(len(by_reverse))
    tree = WaveletTree(place[order[is_point[order]]])
    ahead, behind = ((o, _shared(x[o]), np.concatenate([[0], np.cumsum(is_point[o])])) for o, x in ((order, letters), (reverse, mirrored)))
    # a word of full length is always in its own rectangle
    least = np.where(is_point, 2, 1)
    waiting: list[tuple] = []

    def answered(waiting: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        who, at, left, right, low, high = map(np.concatenate, zip(*waiting, strict=True))
        which, value = tree.report(left, right, low, high)
        a, b, i = who[which], by_reverse[value], at[which]
        keep = a != b
        # of equal letters in a row only the first counts as inserted
        keep &= is_point[a] | (i == 0) | (letters[b, i] != letters[b, i - 1])
        return a[keep], b[keep]

    held = 0
    for i in range(first, last):
        left, right = _intervals(*ahead, i)
        some = np.flatnonzero(right - left >= least)
        if not len(some):
            continue
        low, high = _intervals(*behind, longer - 1 - i)
        some = some[(high - low)[some] >= least[some]]
        if len(some):
            waiting.append((some, np.full(len(some), i), left[some], right[some], low[some], high[some]))
            held += len(some)
        if held >= STEP:
            yield answered(waiting)
            waiting, held = [], 0
    if waiting:
        yield answered(waiting)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(words, counts, near pairs) of each combination of lengths and places in a task's rows."""
    held = list(batches)
    rows = pa.Table.from_batches(held) if held else None
    if rows is None or not rows.num_rows:
        return
    longer, first, last = (rows[c].to_numpy().astype(np.int64) for c in ("longer", "first", "last"))
    order = np.lexsort((last, first, longer))
    edges = np.flatnonzero((np.diff(longer[order]) != 0) | (np.diff(first[order]) != 0) | (np.diff(last[order]) != 0)) + 1
    for at in np.split(order, edges):
        words = [w.encode("latin-1") for w in rows["word"].take(pa.array(at)).to_pylist()]
        k = at[0]
        yield words, rows["n"].to_numpy()[at], near_in_group(words, int(longer[k]), int(first[k]), int(last[k]))


def _tasks(rows: DataFrame) -> DataFrame:
    letters = rows.agg(F.sum(F.char_length("word"))).first()[0] or 0
    tasks = max(1, -(-letters // TASK_LETTERS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "key").select("longer", "first", "last", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): every two words (word, n) that differ by one code point, both ways round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, found in _groups(batches):
            names = pa.array([w.decode("latin-1") for w in words], pa.string())
            size = np.fromiter(map(len, words), np.int64, len(words))
            for a, b in found:
                back = size[a] != size[b]
                x, y = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y))], ["word", "near"])

    return _tasks(dealt(words)).mapInArrow(run, "word string, near string")


def best_near(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): of each word with near words their number, and the most frequent, the smallest of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n, found in _groups(batches):
            size = np.fromiter(map(len, words), np.int64, len(words))
            # from the best word down
            rank = np.empty(len(words), np.int64)
            best_first = np.lexsort((np.argsort(np.argsort(np.array(words, f"S{int(size.max())}"), kind="stable")), -n))
            rank[best_first] = np.arange(len(words))
            count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
            for a, b in found:
                back = size[a] != size[b]
                x, y = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
                count += np.bincount(x, minlength=len(words))
                np.minimum.at(best, x, rank[y])
            some = np.flatnonzero(count)
            if len(some):
                names = pa.array([w.decode("latin-1") for w in words], pa.string())
                near = best_first[best[some]]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(count[some]), pa.array(n[near].astype(np.int64)), names.take(pa.array(near))], ["word", "n_near", "near_n", "near"])

    pieces = _tasks(dealt(words)).mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return pieces.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` (word, form, ...) with ``root``: from word, follow forms to the last.

    Every step leads to a word that is RATIO times as frequent, so chains are
    short; each round doubles how far every word sees.
    """
    links = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(onward, "root")
        if longer.isEmpty():
            return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
        before = links
        links = materialize(before.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-links")
        drop_table(before)


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word: see the module."""
    words = materialize(counted_words(documents), "spelling-words")
    near = best_near(words)
    is_form = F.col("near_n") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n"))
    found = materialize(found, "spelling-forms")
    drop_table(words)
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def oracle() -> str:
    """The same result in DuckDB: CRC-32 byte by byte, near words by the forms that lack one code point."""
    polynomial = 0xEDB88320
    return rf"""
WITH RECURSIVE bits AS (
  SELECT v, v AS c, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS v)
  UNION ALL
  SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST_LENGTH},}}')) AS run FROM documents)
), once AS (
  SELECT w, doc_id, count(*) AS times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs GROUP BY ALL
), hashed AS (
  SELECT w, times, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda p: (strpos('0123456789ABCDEF', x[2 * p + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * p + 2]) - 1), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM once, crc
), lost AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, times FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM lost WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}
), lacking AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM lacking a JOIN lacking b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM lacking l JOIN words w ON w.word = l.v
  UNION SELECT w.word, l.word, l.n FROM lacking l JOIN words w ON w.word = l.v
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY word
), found AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n,
    CASE WHEN b.near_n >= {RATIO} * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.near_n) END AS form
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS here, 0 AS k FROM found
  UNION ALL
  SELECT c.word, f.form, k + 1 FROM chain c JOIN found f ON f.word = c.here WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)
"""
