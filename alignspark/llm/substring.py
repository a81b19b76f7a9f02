"""Near-duplicate passages by compact windows.

Tokens are the hashes of five-word shingles; a passage of MIN_WORDS words has
MIN_WORDS - 4 of them.  For a min-hash function, all passages of a text that
share a minimum at place c and stretch over l..r (l <= first <= c <= last <= r)
form one compact window; the windows are the nodes of the Cartesian tree of the
token hashes.  Only windows that hold a whole passage of minimal length matter.
Their centres are the minima of the sliding spans of that length, and the tree
over the centres alone gives the same bounds, as the nearest smaller value on
either side of a wide window is itself the minimum of a span.  That leaves
about 2 / (MIN_WORDS - 3) windows a word and function.

Documents of one text are one for all of this: their smallest id stands for
them, and each of them has one passage, the whole text.

Windows with equal minimum tokens are joined if they overlap, aligned at their
centres, in a passage of minimal length.  Function 0 keys its windows by the
token and the CONTEXT words left (and, as another key, right) of it: any equal
passage of MIN_WORDS words has one of the two, so none is missed.  Functions 1
to 3 key by the token alone and find passages with changed words; a pair goes
on if function 0 or two of the others meet.  Each document of a key meets one
other of it (the smallest, or for the smallest the largest), so a passage that
a third of all documents share gives one pair a document; the pairs of a
document that many meet are dealt out by a salt.

That partner need not be the one that holds the passage.  So the windows of a
key that more than two have are all compared with each other, by the shingles
up to a passage's length around their centres (:func:`crowded`): whatever part
of a window is in a passage with any other one is so with one that it meets.
A key of very many windows is compared block against block, over many tasks.

Equal passages do not depend on that one partner.  Every run of MIN_WORDS words
whose function-0 window has a key in another document is hashed as a whole and
grouped by that hash, so each document meets one that holds the run in full,
and all places of a repeated run are found.

Pairs are verified on the texts: along each shift at which they met, equal
shingles are marked, and runs are joined while 8 of 9 shingles are equal (a
similarity of 0.8), then reported from MIN_WORDS words on, in both documents.

Defined results: words are letters, digits and non-ASCII characters, A-Z in
lower case; null and empty texts have no passages; passages that only recur
within one document are not reported; rows with a null id are left out; rows
with one id are one document, of which every text is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignspark.llm.common import BROADCAST_IDS, broadcast_if_small, distinct_texts, drop_path, drop_table, let_go, materialize, new_path, with_texts
from alignspark.llm.segments import ragged
from alignspark.llm.words import ALNUM, mix, shingles, steps, words

SHINGLE = 5
MIN_WORDS = 50
CONTEXT = 23
FUNCTIONS = 4
#: Pairs of one document from which its text is dealt out by a salt.
HUB = 512
#: Bits of a place within one step; its other bits order the hashes.
PLACE_BITS = 26
#: Reach of a window to either side that is written down at most: more never decides.
REACH = 63
#: Shingles to either side of a centre that windows of one key are compared by.
AROUND = MIN_WORDS - SHINGLE
#: Equal shingles around their centres from which two windows are worth a look, though a word more or less breaks their passage.
ALIKE = 12
#: Windows of one key in a block; a task compares two blocks at a time.
CROWD = 4096
#: Windows that look at their next candidates together, and marks of candidates that these hold at most.
LOOKED_AT, MARKS = 4096, 1 << 22
#: Shingles of a piece by which windows of one key are looked up.
PIECE = 3

_rng = np.random.default_rng(11)
_SEED = _rng.integers(1, 2**63, size=FUNCTIONS, dtype=np.uint64)
_POWERS = np.multiply.accumulate(np.full(CONTEXT, np.uint64(0x9E3779B97F4A7C15)))
_GRAM_POWERS = np.multiply.accumulate(np.full(MIN_WORDS // SHINGLE, np.uint64(0xD6E8FEB86659FD93)))


def span_minima(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each run of ``span`` values (the first starts at 0)."""
    n = len(values)
    if n < span:
        return values[:0]
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - span + 1], before[span - 1 : n])


def compact_windows(tokens: np.ndarray, first: np.ndarray, seed: np.uint64, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, centre, left, right) of all compact windows of at least ``span`` tokens; places count through all texts."""
    place = np.arange(len(tokens), dtype=np.uint64)
    values = (mix(tokens ^ seed) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
    low = span_minima(values, span)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = owner[: len(low)] == owner[span - 1 :] if len(low) else np.zeros(0, bool)
    centre = (low[whole] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    centre = centre[np.append(True, centre[1:] != centre[:-1])] if len(centre) else centre
    if not len(centre):
        return centre, centre, centre, centre
    own = owner[centre]
    left, right = first[own].copy(), first[own + 1] - 1
    stack: list[int] = []
    at, doc = centre.tolist(), own.tolist()
    ranks = values[centre].tolist()
    for i in range(len(at)):  # nearest smaller values on both sides: the Cartesian tree
        if stack and doc[stack[-1]] != doc[i]:
            stack.clear()
        while stack and ranks[stack[-1]] > ranks[i]:
            right[stack.pop()] = at[i] - 1
        if stack:
            left[i] = at[stack[-1]] + 1
        stack.append(i)
    return own, centre, left, right


def context_keys(hashes: np.ndarray, first_word: np.ndarray, tokens: np.ndarray, first: np.ndarray, own: np.ndarray, centre: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which windows have them, their keys) for the words left and then right of the centres."""
    token, word = tokens[centre], first_word[own] + centre - first[own]
    has = word - first_word[own] >= CONTEXT
    around = (hashes[word[has, None] + np.arange(-CONTEXT, 0)] * _POWERS).sum(axis=1, dtype=np.uint64)
    yield has, mix(token[has] ^ mix(around))
    has = word + SHINGLE + CONTEXT <= first_word[own + 1]
    around = (hashes[word[has, None] + np.arange(SHINGLE, SHINGLE + CONTEXT)] * _POWERS).sum(axis=1, dtype=np.uint64)
    yield has, mix(token[has] + mix(around) + np.uint64(1))


def _apart(own: np.ndarray, key: np.ndarray, centre: np.ndarray, span: int) -> np.ndarray:
    """Of the sorted windows of one text and key, the first and then each that is a span or more behind the last one taken.

    A word said over and over gives the same window at every place: one a span stands for them.
    """
    if not len(own):
        return np.zeros(0, np.int64)
    new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
    group = np.cumsum(new)
    place = (group << 32) + centre
    taken, at = new.copy(), np.flatnonzero(new)
    while len(at):
        then = np.searchsorted(place, place[at] + span)
        inside = then < len(place)
        inside[inside] = group[then[inside]] == group[at[inside]]
        at = then[inside]
        taken[at] = True
    return np.flatnonzero(taken)


def _window_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, packed) of the windows of all functions."""
    span = MIN_WORDS - SHINGLE + 1
    for lo, hi in steps(texts):
        hashes, first_word = words(texts.slice(lo, hi - lo), ALNUM)
        long = np.flatnonzero(np.diff(first_word) >= MIN_WORDS)
        if not len(long):
            continue
        tokens, first = shingles(hashes, first_word, SHINGLE)
        if len(tokens) >= 1 << PLACE_BITS:
            raise ValueError("a text has too many words for one window table")
        parts = []
        for f in range(FUNCTIONS):
            own, centre, left, right = compact_windows(tokens, first, _SEED[f], span)
            reach = (np.minimum(centre - left, REACH) << 6) | np.minimum(right - centre, REACH)
            packed = ((centre - first[own]) << 16) | (reach << 4) | f
            token = tokens[centre]
            if f:
                parts.append((own, mix(token ^ _SEED[f]), packed, centre))
                continue
            for has, near_by in context_keys(hashes, first_word, tokens, first, own, centre):
                parts.append((own[has], near_by, packed[has], centre[has]))
        own, key, packed, centre = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((centre, key, own))
        own, key, packed, centre = own[order], key[order], packed[order], centre[order]
        some = _apart(own, key, centre, span)
        yield lo + own[some], key[some], packed[some]


def windows(documents: DataFrame, id_col: str) -> DataFrame:
    src = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, key, packed in _window_rows(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(packed.astype(np.int64))], names=["key", "doc", "packed"])

    return src.mapInArrow(run, "key bigint, doc bigint, packed bigint")


def _reach(packed, shift: int):
    return F.shiftright(packed, shift).bitwiseAND(REACH)


def shared_windows(windows_: DataFrame) -> DataFrame:
    """The windows whose key several documents have, each with the window of another document that it meets."""
    entry = F.struct("doc", "packed")
    heads = windows_.groupBy("key").agg(F.min(entry).alias("low"), F.max(entry).alias("high"), F.count(F.lit(1)).alias("windows")).where("low.doc < high.doc")
    return windows_.join(heads, "key").select("key", "doc", "packed", "windows", F.when(F.col("doc") == F.col("low.doc"), F.col("high")).otherwise(F.col("low")).alias("with"))


def _gram_rows(texts: pa.Array, keys: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, gram, start) of the runs of MIN_WORDS words whose function-0 window has one of the row's ``keys``."""
    span = MIN_WORDS - SHINGLE + 1
    for lo, hi in steps(texts):
        hashes, first_word = words(texts.slice(lo, hi - lo), ALNUM)
        tokens, first = shingles(hashes, first_word, SHINGLE)
        own, centre, left, right = compact_windows(tokens, first, _SEED[0], span)
        if not len(own):
            continue
        wanted = keys.slice(lo, hi - lo)
        of_row = np.repeat(np.arange(hi - lo), wanted.value_lengths().to_numpy()).astype(np.uint64)
        known = mix(wanted.flatten().to_numpy().view(np.uint64) + mix(of_row))
        shared = np.zeros(len(own), bool)
        for has, key in context_keys(hashes, first_word, tokens, first, own, centre):
            shared[has] |= np.isin(mix(key + mix(own[has].astype(np.uint64))), known)
        own, centre, left, right = own[shared], centre[shared], left[shared], right[shared]
        begin, end = np.maximum(left, centre - span + 1), np.minimum(right - span + 1, centre)
        start = ragged(begin, end - begin + 1, np.arange(len(own)))
        own = np.repeat(own, end - begin + 1)
        gram = np.zeros(len(start), np.uint64)
        for k, power in enumerate(_GRAM_POWERS):
            gram += tokens[start + k * SHINGLE] * power
        yield lo + own, mix(gram), start - first[own]


def _then(df: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], then: str) -> DataFrame:
    """``materialize(step(df), then)``, for which ``df`` is written only as long as it is read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    let_go(df.sparkSession)
    out = materialize(step(df.sparkSession.read.schema(df.schema).parquet(path)), then)
    drop_path(df.sparkSession, path)
    let_go(df.sparkSession)
    return out


def equal_passages(shared: DataFrame, documents: DataFrame, id_col: str) -> DataFrame:
    """(doc, start, end, other): every run of MIN_WORDS words that another document holds word for word."""
    keys = shared.where(F.col("packed").bitwiseAND(15) == 0).groupBy("doc").agg(F.collect_set("key").alias("keys"))
    keys = materialize(keys, "passage-keys")
    texts = distinct_texts(documents, keys.select(F.col("doc").alias("id")), id_col)
    keyed = texts.join(keys, texts.id == keys.doc).select("doc", F.explode("texts").alias("text"), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, gram, start in _gram_rows(batch.column(1), batch.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(ids[row]), pa.array(start.astype(np.int32))], names=["gram", "doc", "start"])

    def repeated(grams: DataFrame) -> DataFrame:
        heads = grams.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
        return grams.join(heads.select("gram", "low"), "gram")

    held = _then(keyed.mapInArrow(run, "gram bigint, doc bigint, start int"), "passage-grams", repeated, "equal-passages")
    second = held.where("doc > low").groupBy("gram").agg(F.min("doc").alias("other"))
    first = held.where("doc = low").join(second, "gram").select("doc", "start", "other")
    every = held.where("doc > low").select("doc", "start", F.col("low").alias("other")).unionByName(first)
    spans = materialize(every.select("doc", "start", (F.col("start") + MIN_WORDS).alias("end"), "other"), "equal-spans")
    drop_table(held)
    drop_table(keys)
    let_go(documents.sparkSession)
    return spans


def _surroundings(tokens: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """A row a window: 16 bits of each shingle around its centre, 0 beyond the window."""
    place, steps_ = packed >> 16, np.arange(-AROUND, AROUND + 1)
    inside = (steps_ >= -((packed >> 10) & REACH)[:, None]) & (steps_ <= ((packed >> 4) & REACH)[:, None])
    at = place[:, None] + steps_
    inside &= (at >= 0) & (at < len(tokens))
    short = (tokens % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    return np.where(inside, short[np.clip(at, 0, len(tokens) - 1)], np.uint16(0))


def _in_passages(equal: np.ndarray) -> np.ndarray:
    """Of rows of marks, the places within a passage's length of which 8 of 9 are marked."""
    span = AROUND + 1
    sums = np.zeros((len(equal), equal.shape[1] + 1), np.int16)
    np.cumsum(equal, axis=1, out=sums[:, 1:])
    change = np.zeros(sums.shape, np.int16)
    dense = sums[:, span:] - sums[:, :-span] >= span * 8 // 9
    change[:, : dense.shape[1]] += dense
    change[:, span : span + dense.shape[1]] -= dense
    return np.cumsum(change, axis=1)[:, :-1] > 0


def _crowd_pairs(doc: np.ndarray, around: np.ndarray, first: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """(window, window) of one key that meet; windows are in the order of their documents, key k's are first[k]:first[k + 1].

    A window meets those that hold a part of it in a passage, until every such part is met, and of those that are alike
    without one along this shift, the ones that add equal shingles.  Both kinds share a piece of PIECE shingles off the
    centre: of 46 shingles with 8 of 9 equal, some piece is whole.  So windows are looked up by their pieces, not one by one.
    Many windows, of whatever keys, take a step together: each looks at its next candidate in the order of documents.
    """
    first = np.array([0, len(doc)]) if first is None else first
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    firsts = [o for o in range(0, around.shape[1] - PIECE + 1, PIECE) if not o <= AROUND < o + PIECE]
    order, start, end = (np.empty((len(firsts), len(doc)), np.int32) for _ in range(3))
    shared = np.empty(order.shape, bool)
    for k, o in enumerate(firsts):
        code = np.zeros(len(doc), np.uint64)
        for x in range(PIECE):
            code = (code << np.uint64(16)) | around[:, o + x]
        by = np.lexsort((code, group))
        new = np.flatnonzero(np.append(True, (np.diff(code[by]) != 0) | (np.diff(group[by]) != 0))) if len(by) else by
        size = np.diff(np.append(new, len(doc)))
        order[k], start[k, by], end[k, by] = by, np.repeat(new, size), np.repeat(new + size, size)
        shared[k] = (around[:, o : o + PIECE] != 0).all(axis=1) & (end[k] - start[k] > 1)
    windows_, size = np.flatnonzero(shared.any(axis=0)), np.diff(first)[group]
    windows_ = windows_[np.argsort(size[windows_], kind="stable")]  # keys of one size share a step
    lo = 0
    while lo < len(windows_):
        mine = windows_[lo : lo + LOOKED_AT]
        fits = size[mine] * np.arange(1, len(mine) + 1) <= MARKS
        mine = mine[: max(1, int(fits.sum()))]
        lo += len(mine)
        yield from _next_ones(mine, doc, around, first[group[mine]], int(size[mine[-1]]), firsts, order, start, end, shared)


def _next_ones(mine: np.ndarray, doc: np.ndarray, around: np.ndarray, base: np.ndarray, spread: int, firsts: list[int], order: np.ndarray, start: np.ndarray, end: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs of windows ``mine``, whose keys' windows begin at ``base``."""
    own = around[mine]
    some = own != 0
    to_cover, seen = some.copy(), np.zeros(own.shape, bool)
    to_cover[:, AROUND] = False  # the key's own shingle, which all have
    # the two smallest documents of a piece often cover all of a window
    marks = np.zeros((len(mine), spread), bool)
    for k in range(len(firsts)):
        rows = np.flatnonzero(shared[k, mine])
        for x in (0, 1):
            marks[rows, order[k, start[k, mine[rows]] + x] - base[rows]] = True
    who, there = np.nonzero(marks)
    there += base[who]
    others = doc[there] != doc[mine[who]]
    who, there = who[others], there[others]
    count = np.bincount(who, minlength=len(mine))
    at, turn = np.cumsum(count) - count, 0
    live = np.flatnonzero(count)
    while len(live):
        now = there[at[live] + turn]
        equal = (around[now] == own[live]) & some[live]
        alike = equal.sum(axis=1)
        near = np.flatnonzero(alike >= ALIKE)
        if len(near):
            rows, equal = live[near], equal[near]
            many, held = alike[near] >= (AROUND + 1) * 8 // 9, np.zeros(equal.shape, bool)
            if many.any():
                held[many] = _in_passages(equal[many])
            held &= to_cover[rows]
            use = held.any(axis=1) | ((equal & to_cover[rows] & ~seen[rows]).sum(axis=1) >= ALIKE)
            yield from zip(mine[rows[use]].tolist(), now[near[use]].tolist(), strict=True)
            to_cover[rows[use]] &= ~held[use]
            seen[rows[use]] |= equal[use]
        turn += 1
        live = live[(count[live] > turn) & to_cover[live].any(axis=1)]
    left = np.array([shared[k, mine] & (end[k, mine] - start[k, mine] > 2) & to_cover[:, o : o + PIECE].any(axis=1) for k, o in enumerate(firsts)])
    for w in np.flatnonzero(left.any(axis=0)).tolist():  # all others of the pieces that are left
        i, wanted = mine[w], np.zeros(spread, bool)
        for k in np.flatnonzero(left[:, w]).tolist():
            wanted[order[k, start[k, i] : end[k, i]] - base[w]] = True
        every = np.flatnonzero(wanted & ~marks[w]) + base[w]
        every = every[doc[every] != doc[i]]
        for lo in range(0, len(every), LOOKED_AT):
            there = every[lo : lo + LOOKED_AT]
            equal = (around[there] == own[w]) & some[w]
            alike = equal.sum(axis=1)
            near = np.flatnonzero((alike >= ALIKE) & ((alike >= (AROUND + 1) * 8 // 9) | ((equal & (to_cover[w] & ~seen[w])).sum(axis=1) >= ALIKE)))
            there, equal, many = there[near], equal[near], alike[near] >= (AROUND + 1) * 8 // 9
            held = np.zeros(equal.shape, bool)
            if many.any():
                held[many] = _in_passages(equal[many])
            while len(there):
                held &= to_cover[w]
                use = np.flatnonzero(held.any(axis=1) | ((equal & (to_cover[w] & ~seen[w])).sum(axis=1) >= ALIKE))
                if not len(use):
                    break
                yield i, int(there[use[0]])
                to_cover[w] &= ~held[use[0]]
                seen[w] |= equal[use[0]]
                there, equal, held = there[use[0] + 1 :], equal[use[0] + 1 :], held[use[0] + 1 :]


def crowded(shared: DataFrame, documents: DataFrame, id_col: str) -> DataFrame:
    """(a, b, shift): documents whose windows of a key that more than two have are alike around their centres."""
    held = shared.where("windows > 2").select("key", "doc", "packed").distinct()
    held = materialize(held.groupBy("doc").agg(F.collect_list(F.struct("key", "packed")).alias("held")), "crowded-windows")
    texts = distinct_texts(documents, held.select(F.col("doc").alias("id")), id_col)
    keyed = texts.join(held, texts.id == held.doc).select("doc", F.explode("texts").alias("text"), "held")
    names = ["key", "doc", "place", "around"]

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            of_row = batch.column(2)
            for lo, hi in steps(batch.column(1)):
                tokens, first = shingles(*words(batch.column(1).slice(lo, hi - lo), ALNUM), SHINGLE)
                for i in range(lo, hi):
                    mine, own = of_row[i].values, tokens[first[i - lo] : first[i - lo + 1]]
                    if not len(own):
                        continue
                    packed = mine.field("packed").to_numpy()
                    around = _surroundings(own, packed)
                    body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(around.shape[1] * 2), len(packed), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([mine.field("key"), pa.array(np.full(len(packed), ids[i])), pa.array((packed >> 16).astype(np.int32)), body], names=names)

    rows = keyed.mapInArrow(surround, "key bigint, doc bigint, place int, around binary")
    # documents with the same surroundings hold an equal passage; the smallest stands for them, with all its places
    kinds = rows.groupBy("key", "around", "doc").agg(F.collect_set("place").alias("places"))
    kinds = kinds.groupBy("key", "around").agg(F.min(F.struct("doc", "places")).alias("x")).select("key", "around", "x.doc", "x.places")
    kinds = materialize(kinds, "crowded-kinds")
    sizes = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("windows")).where("windows > 1")
    blocks = F.ceil(F.col("windows") / CROWD).cast("int")
    mine = F.pmod(F.xxhash64("doc", "around"), blocks).cast("int")
    with_block = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    placed = kinds.join(sizes, "key").select("key", mine.alias("mine"), with_block, "doc", "places", "around")
    placed = placed.select("key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "doc", "places", "around")
    placed = placed.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def met(table: pa.Table) -> pa.RecordBatch:
            key, one, two, doc = (table.column(k).to_numpy() for k in range(4))
            places = table.column(4).to_pylist()
            around = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint16).reshape(len(doc), -1)
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
            pairs: list[tuple[int, int, int]] = []
            for i, k in _crowd_pairs(doc, around, np.concatenate([[0], edges, [len(doc)]])):
                i, k = (i, k) if doc[i] > doc[k] else (k, i)
                # each place of either with one of the other
                shifts = {x - places[k][0] for x in places[i]} | {places[i][0] - y for y in places[k]}
                pairs += [(doc[i], doc[k], x) for x in shifts]
            a, b, shift = np.array(pairs, np.int64).reshape(-1, 3).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shift.astype(np.int32))], names=["a", "b", "shift"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = [table.column(k).to_numpy() for k in range(3)]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield met(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield met(rest)

    pairs = materialize(placed.mapInArrow(compare, "a bigint, b bigint, shift int").distinct(), "crowded-pairs")
    drop_table(held)
    drop_table(kinds)
    let_go(documents.sparkSession)
    return pairs


def meetings(shared: DataFrame) -> DataFrame:
    """(doc, other, shifts): which documents meet by enough functions, and how far they are shifted."""
    span = MIN_WORDS - SHINGLE + 1
    mine, theirs = F.col("packed"), F.col("with.packed")
    overlap = F.least(_reach(mine, 10), _reach(theirs, 10)) + F.least(_reach(mine, 4), _reach(theirs, 4)) + 1
    met = shared.where(overlap >= span).select(
        "doc", F.col("with.doc").alias("other"), (F.shiftright(mine, 16) - F.shiftright(theirs, 16)).cast("int").alias("shift"),
        F.expr("shiftleft(1, int(packed & 15))").alias("kind"),
    )
    met = met.select(F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b"), F.when(F.col("doc") > F.col("other"), F.col("shift")).otherwise(-F.col("shift")).alias("shift"), "kind")
    return (
        met.groupBy("a", "b", "shift").agg(F.bit_or("kind").alias("kinds"))
        .groupBy("a", "b").agg(F.bit_or("kinds").alias("kinds"), F.collect_set("shift").alias("shifts"))
        .where((F.col("kinds").bitwiseAND(1) > 0) | (F.bit_count("kinds") >= 2)).select("a", "b", "shifts")
    )


def dense_runs(marked: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of runs of marks, joined while 8 of 9 stay marked, of at least ``least`` places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    start = end = count = 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if count and 9 * (count + b - a) >= 8 * (b - start):
            end, count = b, count + b - a
        else:
            if count and end - start >= least:
                out.append((start, end))
            start, end, count = a, b, b - a
    if count and end - start >= least:
        out.append((start, end))
    return out


def shared_passages(a: np.ndarray, b: np.ndarray, shifts: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Word spans in two texts (given by their shingles) that are alike along the shifts."""
    mark_a, mark_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for d in shifts:  # place i of a stands at i - d of b
        lo, hi = max(0, d), min(len(a), len(b) + d)
        if hi > lo:
            same = a[lo:hi] == b[lo - d : hi - d]
            mark_a[lo:hi] |= same
            mark_b[lo - d : hi - d] |= same
    least = MIN_WORDS - SHINGLE + 1
    return tuple([(s, e + SHINGLE - 1) for s, e in dense_runs(m, least)] for m in (mark_a, mark_b))


def copies(documents: DataFrame, id_col: str) -> DataFrame:
    """(doc, digest, stands, other): the documents whose text another document has; ``stands`` is the smallest of them.

    ``other`` is the smallest but the document itself.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc"), _digest(F.col("text")).alias("digest")).where("doc is not null").distinct()
    rows = materialize(rows, "text-digests")
    # the two smallest: each is a minimum formed before the shuffle
    low = rows.groupBy("digest").agg(F.min("doc").alias("stands"), F.max("doc").alias("last")).where("stands < last").select("digest", "stands")
    held = rows.join(low, "digest")
    second = held.where("doc > stands").groupBy("digest").agg(F.min("doc").alias("second"))
    found = held.join(second, "digest").select("doc", "digest", "stands", F.when(F.col("doc") == F.col("stands"), F.col("second")).otherwise(F.col("stands")).alias("other"))
    return materialize(found, "copies")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def word_counts(documents: DataFrame, id_col: str) -> DataFrame:
    """(doc, digest, n_words) of every row."""
    src = documents.select(F.col(id_col).cast("bigint").alias("doc"), _digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(2)):
                n = np.diff(words(batch.column(2).slice(lo, hi - lo), ALNUM)[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int32))], names=["doc", "digest", "n_words"])

    return src.mapInArrow(run, "doc bigint, digest binary, n_words int")


def repeated_passages(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start_word, end_word (exclusive), n_words and other_doc of every passage that another document holds.

    Overlapping passages of a document are one; ``other_doc`` is the smallest
    document that was found to hold part of it.
    """
    same = copies(documents, id_col)
    more = broadcast_if_small(same.where("doc > stands").select("doc", "digest"), BROADCAST_IDS)
    stands = broadcast_if_small(same.where("doc = stands").select("doc", "digest"), BROADCAST_IDS)
    keyed = documents.select(F.col(id_col).cast("bigint").alias("doc"), _digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text")).where("doc is not null")
    found = _distinct_passages(keyed.join(more, ["doc", "digest"], "left_anti").select("doc", "text"), "doc")
    size = word_counts(keyed.join(stands, ["doc", "digest"], "left_semi"), "doc").where(F.col("n_words") >= MIN_WORDS).select("digest", "n_words").distinct()
    whole = same.join(size, "digest").select("doc", F.lit(0).alias("start"), F.col("n_words").alias("end"), "other")
    # what a copy shares with other texts lies within its whole text
    own = found.join(same.select("doc", "stands").distinct(), "doc").groupBy("stands").agg(F.min("other").alias("besides"))
    whole = whole.join(same.select("doc", "stands").distinct(), "doc").join(own, "stands", "left").select("doc", "start", "end", F.least("other", F.coalesce("besides", "other")).alias("other"))
    return _merged(found.unionByName(whole)).select(F.col("doc").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc")


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, start_word, end_word, other_doc): spans (doc, start, end, other) of a document that overlap are one.

    Spans that begin in the same half of MIN_WORDS words overlap for sure, so they are one before anything is sorted.
    """
    near = F.floor(F.col("start") / (MIN_WORDS // 2)).cast("int")
    few = spans.repartition("doc").groupBy("doc", near.alias("part")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
    in_order = W.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    numbered = few.withColumn("new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int")).withColumn("passage", F.sum("new").over(in_order))
    return numbered.groupBy("doc", "passage").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc"))


def _distinct_passages(documents: DataFrame, id_col: str) -> DataFrame:
    """(doc, start, end, other) of the passages that documents of different texts share."""
    found = _then(windows(documents, id_col), "compact-windows", shared_windows, "shared-windows")
    let_go(documents.sparkSession)
    pairs = materialize(meetings(found), "passage-meetings")
    equal = equal_passages(found, documents, id_col)
    more = crowded(found, documents, id_col)
    drop_table(found)
    let_go(documents.sparkSession)
    every = pairs.unionByName(more.groupBy("a", "b").agg(F.collect_set("shift").alias("shifts")))
    pairs = materialize(every.groupBy("a", "b").agg(F.array_distinct(F.flatten(F.collect_list("shifts"))).alias("shifts")), "passage-pairs")
    both = with_texts(pairs, documents, id_col, HUB)

    def tokens_of(texts: pa.Array) -> Iterator[np.ndarray]:
        for lo, hi in steps(texts):
            s, first = shingles(*words(texts.slice(lo, hi - lo), ALNUM), SHINGLE)
            for i in range(hi - lo):
                yield s[first[i] : first[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column(3), batch.column(4)
            hubs = theirs.flatten().dictionary_encode()
            known, number = list(tokens_of(hubs.dictionary)), hubs.indices.to_numpy()
            sets = tokens_of(mine.flatten())
            rows, at = [], 0
            for a, b, shifts, n_mine, n_theirs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), mine.value_lengths().to_pylist(), theirs.value_lengths().to_pylist(), strict=True):
                for s in [next(sets) for _ in range(n_mine)]:
                    for k in number[at : at + n_theirs]:
                        of_a, of_b = shared_passages(s, known[k], shifts)
                        rows += [(a, x, y, b) for x, y in of_a] + [(b, x, y, a) for x, y in of_b]
                at += n_theirs
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["doc", "start", "end", "other"])

    spans = both.mapInArrow(run, "doc bigint, start int, end int, other bigint").unionByName(equal)
    return materialize(_merged(spans).select("doc", F.col("start_word").alias("start"), F.col("end_word").alias("end"), F.col("other_doc").alias("other")), "distinct-passages")
