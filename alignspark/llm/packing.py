"""Conflict-constrained best-fit packing of documents into bins of a token capacity.

Documents are dealt by a hash of their id to shards of about ``SHARD``
documents; the number of shards grows with the input, no source or cluster
decides where a document goes, and each shard is packed on its own.  Within a
shard, pieces go longest first.  Bins are kept ordered by what room is left
(a bit per residual, a list of bins behind it) and carry bitmaps: one bit a
duplicate cluster, and ``max_per_source`` planes of one bit a source.  A piece
looks at the smallest residual that holds it, then at its successors, until a
bin has neither its cluster nor a full count of its source; else it opens a
bin.  So each piece gets the tightest compatible bin.

Defined results: a document longer than the capacity is cut into full pieces
and a rest, no token is lost; full pieces fill bins of their own.  A document
without tokens (null or empty text) has one row with a null bin.  A null source
is a source like others; a null cluster conflicts with nothing; rows with one
id are packed one by one; an empty table gives no rows.  Ties go by id.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignspark.llm import tokens

CAPACITY = 4096
MAX_PER_SOURCE = 2
SHARD = 4096
#: Bits of a bin's number within its shard.
BIN_BITS = 32


def pack_shard(pieces: list[tuple[int, int, int | None]], capacity: int, max_per_source: int) -> list[int]:
    """The bin of each piece (tokens, source, cluster), taken in the order given."""
    shared = {c for c, n in Counter(c for _, _, c in pieces if c is not None).items() if n > 1}
    number = {c: i for i, c in enumerate(sorted(shared))}
    behind: dict[int, list[int]] = {}  # residual -> bins
    open_bits = 0  # residuals that have bins
    clusters: list[int] = []
    planes: list[list[int]] = []
    out = []
    for size, source, cluster in pieces:
        own, mark = 1 << source, 1 << number[cluster] if cluster in shared else 0
        left = open_bits >> size << size
        chosen = -1
        while left:
            room = (left & -left).bit_length() - 1
            for k, b in enumerate(behind[room]):
                if not clusters[b] & mark and not planes[b][-1] & own:
                    chosen = b
                    break
            if chosen >= 0:
                behind[room].pop(k)
                if not behind[room]:
                    open_bits &= ~(1 << room)
                break
            left &= left - 1
        if chosen < 0:
            chosen, room = len(clusters), capacity
            clusters.append(0)
            planes.append([0] * max_per_source)
        clusters[chosen] |= mark
        for p in range(max_per_source):
            if not planes[chosen][p] & own:
                planes[chosen][p] |= own
                break
        room -= size
        behind.setdefault(room, []).append(chosen)
        open_bits |= 1 << room
        out.append(chosen)
    return out


def same_text(text: Column) -> Column:
    """A cluster for texts that differ only in letter case and white space."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.xxhash64(plain)


def best_fit(documents: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, cluster: Column | None = None, shard: int = SHARD, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id and place (where in the bin the piece begins)."""
    import pandas as pd

    mark = same_text(F.col("text")) if cluster is None else cluster
    carried = F.struct(F.col("doc_id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source"), mark.cast("bigint").alias("cluster"))
    counted = tokens.token_counts(documents.select(carried.alias("key"), F.col("text")), id_col="key", path=tokenizer).select("key.*", "n_tokens")
    shards = max(1, -(-documents.count() // shard))
    dealt = counted.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def run(key, pdf):
        pdf = pdf.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable")
        source = pd.factorize(pdf["source"], use_na_sentinel=False)[0].tolist()
        rows, void = [], []
        for i, s, c, n in zip(pdf["id"].tolist(), source, pdf["cluster"].tolist(), pdf["n_tokens"].tolist(), strict=True):
            if not n:
                void.append((i, 0, 0, 0, None, None))
            rows += [(min(capacity, n - a), i, a // capacity, a, s, None if c is None or pd.isna(c) else int(c)) for a in range(0, n, capacity)]
        # pieces of one document share its cluster; only full ones precede the rest, and those fill a bin each
        rows.sort(key=lambda x: -x[0])
        bins = pack_shard([(x[0], x[4], x[5]) for x in rows], capacity, max_per_source)
        used: Counter = Counter()
        out = []
        for x, b in zip(rows, bins, strict=True):
            out.append((x[1], x[2], x[3], x[0], (int(key[0]) << BIN_BITS) + b, used[b]))
            used[b] += x[0]
        return pd.DataFrame(out + void, columns=["doc_id", "piece", "first_token", "n_tokens", "bin_id", "place"]).astype({"doc_id": "Int64", "bin_id": "Int64", "place": "Int64"})

    schema = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, bin_id bigint, place bigint"
    dealt = dealt.withColumn("cluster", F.col("cluster").cast("string"))  # pandas would round large integers beside nulls
    return dealt.groupBy("shard").applyInPandas(run, schema)
