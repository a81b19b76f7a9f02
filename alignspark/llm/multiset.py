"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed to a
wide vector, and the text's fingerprint is the sum of them, lane by lane, modulo
powers of two.  So the order of paragraphs does not count, two texts have one
fingerprint if they hold the same paragraphs equally often, and inserting or
deleting a paragraph is adding or subtracting its vector (:func:`inserted`,
:func:`deleted`) without the rest of the text.

A paragraph's vector has two parts.  EXACT lanes of 32 bits are hashes of the
whole paragraph: 256 bits that tell multisets apart.  LIKE lanes of 24 bits are
sums of +1 or -1, by the bits of the hash of each word of the paragraph together
with the word before it (the first has none).  The inner product of two texts'
LIKE lanes, over their number, estimates how many word pairs they share, with
multiplicity; :func:`likeness` is twice that over the sum of both squared
lengths, from 0 to 1, and 1 for equal fingerprints.  Its standard error is
some 0.09 for texts that share nothing.

To edit each text with the next one's beginning (:func:`edited`), documents are
dealt out by ranges of their order: the ranges' first documents are found by
sorting ids and hashes alone, and each is also sent to the range before its own
(that of the first range to the last).  Texts are shuffled once; fingerprints
are summed where the range's texts lie.

Defined results: a null text is the empty one; the empty text is one empty
paragraph; documents stand in the order of (id, hash of the text), null ids
first; of rows alike in both each is followed by the next; of a single document
the next is itself; an empty table gives none; other columns are ignored.  LIKE
lanes wrap beyond eight million word pairs of one sign: equality still holds
then, likeness does not.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXACT, EXACT_BITS = 8, 32
LIKE, LIKE_BITS = 128, 24
#: Documents of one range of the order, while there are no more than MOST_RANGES; beyond that the ranges grow.
RANGE, MOST_RANGES = 1000, 65_536

_HALF, _ALL = 1 << (LIKE_BITS - 1), (1 << LIKE_BITS) - 1
_LOW = 0xFFFFFFFF
#: A bit of each half of a long: two counts of 32 bits in one sum.
_TWO = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def pair_hashes(parts: Column) -> Column:
    """A hash of each word with the one before it, in all paragraphs."""
    words = F.transform(parts, lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    return F.flatten(F.transform(words, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(F.get(ws, i - 1), w))))


def exact_lanes(parts: Column) -> Column:
    """EXACT sums of the halves of four hashes of each paragraph, modulo 2^32."""

    def summed(hashes: Column, shift: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: (a + F.shiftrightunsigned(h, shift).bitwiseAND(_LOW)).bitwiseAND(_LOW))

    def hashed(seed: int) -> Column:
        return F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))

    return F.array(*(summed(hashed(seed), shift) for seed in range(EXACT // 2) for shift in (0, 32)))


def wrapped(lanes: Column) -> Column:
    """LIKE lanes as numbers around 0."""
    return F.transform(lanes, lambda x: (x + _HALF).bitwiseAND(_ALL) - _HALF)


def like_sums(hash_: Column) -> list[Column]:
    """Sums over word pairs that hold LIKE counts of set bits, two in each."""
    second = F.when(hash_.isNotNull(), F.xxhash64(hash_))
    return [F.sum(F.shiftright(h, j).bitwiseAND(_TWO)) for h in (hash_, second) for j in range(32)]


def like_lanes(sums: Column, n: Column) -> Column:
    """Ones less zeros, from the sums and the number of word pairs."""
    counts = F.flatten(F.transform(sums, lambda s: F.array(s.bitwiseAND(_LOW), F.shiftrightunsigned(s, 32))))
    return wrapped(F.transform(counts, lambda c: 2 * c - n))


def rendered(exact: Column, like: Column) -> Column:
    """A fingerprint as hexadecimal digits: EXACT lanes of eight, then LIKE lanes of six."""
    wide = lambda lanes, bits: F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND((1 << bits) - 1))), bits // 4, "0")), "")
    return F.concat(wide(exact, EXACT_BITS), wide(like, LIKE_BITS))


def parsed(fingerprint: Column) -> tuple[Column, Column]:
    """(EXACT lanes, LIKE lanes) of a rendered fingerprint."""

    def lanes(first: int, n: int, bits: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.conv(F.substring(fingerprint, first + k * (bits // 4), F.lit(bits // 4)), 16, 10).cast("bigint"))

    return lanes(1, EXACT, EXACT_BITS), wrapped(lanes(1 + EXACT * EXACT_BITS // 4, LIKE, LIKE_BITS))


def _lane_by_lane(a: Column, b: Column, sign: int) -> Column:
    (xa, ya), (xb, yb) = parsed(a), parsed(b)
    return rendered(F.zip_with(xa, xb, lambda x, y: x + sign * y), F.zip_with(ya, yb, lambda x, y: x + sign * y))


def inserted(fingerprint: Column, more: Column) -> Column:
    """The fingerprint of all paragraphs of both; those of ``more`` are inserted anywhere."""
    return _lane_by_lane(fingerprint, more, 1)


def deleted(fingerprint: Column, less: Column) -> Column:
    """The fingerprint without the paragraphs of ``less``, which it holds."""
    return _lane_by_lane(fingerprint, less, -1)


def _likeness(ea: Column, la: Column, eb: Column, lb: Column) -> Column:
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), zero, lambda s, v: s + v)
    both = dot(la, la) + dot(lb, lb)
    found = F.when(both > 0, F.least(F.greatest(2 * dot(la, lb) / F.when(both > 0, both), zero), F.lit(1.0))).otherwise(zero)
    return F.when((ea == eb) & (la == lb), F.lit(1.0)).otherwise(found)


def likeness(a: Column, b: Column) -> Column:
    """How much two texts of these fingerprints share, 0 to 1."""
    (ea, la), (eb, lb) = parsed(a), parsed(b)
    return _likeness(ea, la, eb, lb)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, text) with exact and like lanes in place of the text; one row for each combination of keys."""
    split = rows.withColumn("parts", paragraphs(F.col("text"))).select(*keys, exact_lanes(F.col("parts")).alias("exact"), pair_hashes(F.col("parts")).alias("pairs"))
    # an entry without a pair keeps texts of no words
    each = split.select(*keys, *(F.col("exact")[k].alias(f"e{k}") for k in range(EXACT)), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "pairs")).alias("pair"))
    sums = like_sums(F.col("pair"))
    out = each.groupBy(*keys, *(f"e{k}" for k in range(EXACT))).agg(F.count("pair").alias("n"), *(F.when(F.count("pair") > 0, x).otherwise(F.lit(0).cast("bigint")).alias(f"s{k}") for k, x in enumerate(sums)))
    return out.select(*keys, F.array(*(f"e{k}" for k in range(EXACT))).alias("exact"), like_lanes(F.array(*(f"s{k}" for k in range(len(sums)))), F.col("n")).alias("like"))


def fingerprints(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, fingerprint): one row for each combination of keys, of all paragraphs of its texts."""
    lanes = _summed(rows.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), list(keys))
    if not keys:
        return lanes.select(rendered(F.col("exact"), F.col("like")).alias("fingerprint"))
    return lanes.select(*keys, rendered(F.col("exact"), F.col("like")).alias("fingerprint"))


def ranges(rows: DataFrame) -> list[tuple]:
    """The least (doc_id, twin) of each range of the order: RANGE documents or so, MOST_RANGES entries at most."""
    keys = rows.select("doc_id", "twin")
    n = min(MOST_RANGES, math.ceil(keys.count() / RANGE))
    if n < 2:
        first = keys.orderBy("doc_id", "twin").first()
        return [tuple(first)] if first else []
    least = keys.repartitionByRange(n, "doc_id", "twin").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "twin")).alias("k"))
    return sorted((tuple(r.k) for r in least.collect()), key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1]))


def edited(documents: DataFrame) -> DataFrame:
    """(range, place, tail, doc_id, text, edited): every document in order, and its text with its last quarter replaced by the beginning of the next one's.

    Rows with ``tail`` are the next range's first document, repeated behind the range's last.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("twin", F.xxhash64("text"))
    firsts = ranges(rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    step = max(1, math.isqrt(max(len(firsts) - 1, 0)) + 1)
    as_json = [{"k": {"doc_id": i, "twin": t}} for i, t in firsts]
    groups = [as_json[at : at + step] for at in range(0, len(as_json), step)] or [[]]
    table = F.from_json(F.lit(json.dumps(groups, default=str)), f"array<array<struct<k:struct<doc_id:{kind},twin:bigint>>>>")
    key = F.struct("doc_id", "twin")
    within = lambda xs: F.greatest(F.size(F.filter(xs, lambda b: b["k"] <= F.col("key"))) - 1, F.lit(0))
    rows = rows.withColumn("key", key).withColumn("table", table)
    rows = rows.withColumn("group", F.greatest(F.size(F.filter("table", lambda g: g[0]["k"] <= F.col("key"))) - 1, F.lit(0)))
    rows = rows.withColumn("at", within(F.get("table", F.col("group"))))
    first = F.get(F.get("table", F.col("group")), F.col("at"))["k"] == F.col("key")
    own = F.col("group") * step + F.col("at")
    place = lambda r, tail: F.struct(r.cast("int").alias("range"), F.lit(tail).alias("tail"))
    # the first document of a range is also the last one's next of the range before
    spots = F.when(first, F.array(place(own, False), place(F.pmod(own - 1, F.lit(max(1, len(firsts)))), True))).otherwise(F.array(place(own, False)))
    dealt = rows.select("doc_id", "twin", "text", F.explode(spots).alias("spot")).select("doc_id", "twin", "text", "spot.range", "spot.tail")
    order = W.partitionBy("range").orderBy("tail", "doc_id", "twin")
    rows = dealt.withColumns({"place": F.row_number().over(order), "next": F.lead("text").over(order)})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    new = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    return rows.select("range", "place", "tail", "doc_id", "text", F.when(~F.col("tail"), new).alias("edited"))


def edit_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    rows = edited(documents)
    both = F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("text"), F.char_length("text").cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.lit(0).cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("sha")),
    )
    each = rows.select("range", "place", "tail", "doc_id", F.explode(both).alias("x")).select("range", "place", "tail", "doc_id", "x.*").where("text is not null")
    lanes = _summed(each, ["range", "place", "tail", "doc_id", "which", "n_chars", "sha"])
    order = W.partitionBy("range").orderBy("place", "which")
    # behind a text stand its edited form and the next text
    at = lambda name, k: F.lead(name, k).over(order).alias(f"{name}{k}")
    seen = lanes.select("*", *(at(name, k) for name in ("exact", "like") for k in (1, 2)), at("sha", 1)).where("which = 0 and not tail")
    near = lambda k: _likeness(F.col("exact"), F.col("like"), F.col(f"exact{k}"), F.col(f"like{k}"))
    return seen.select(
        "doc_id", "n_chars", F.col("sha1").alias("edited_sha256"), rendered(F.col("exact"), F.col("like")).alias("fingerprint"),
        rendered(F.col("exact1"), F.col("like1")).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"),
    )
