"""Content-addressed store of token ids.

Layout of a store, all Parquet in one folder:

* ``chunks/`` - a row for each distinct chunk of ids and for further uses of it:
  ``hash`` (BLAKE2b, 16 bytes), ``n_ids``, ``payload`` and ``uses``.  The
  payload (ids as little-endian unsigned 16-bit integers, or 32-bit where the
  vocabulary needs it, zstandard-compressed) stands in exactly one row of each
  hash.  ``uses`` lists where the chunk occurs: document, row (a number that
  only this input row has), position, offset, the document's length and, at its
  first chunk, its root.
* ``recipes/`` - one row per document in ascending id order (range
  partitions, each sorted): ``part``, id, ``n_tokens``, ``root``, the hash of
  its chunk hashes in order (a Merkle manifest of depth one).  Length and root
  are those of the ids as they were encoded.
* ``manifest/`` - one row per recipe partition: its number of documents, its
  ids and its root.  Documents' roots are hashed in order by BLOCK, and these
  hashes in order to the partition's.
* ``root/`` - one row: the hash of all partitions' roots in order, the top of
  the Merkle tree, and the bytes of one stored id.

A rolling hash over the last ``WINDOW`` ids decides where chunks end, so equal
passages give equal chunks wherever they stand.  Ids travel once, to the row of
their chunk; everything else that is shuffled is small.  Chunks are deduplicated
within a task before the shuffle: a chunk that a third of all documents hold
sends its payload once a task (once in SEEN others), with INLINE uses, and all
its further uses are dealt out by SALTS.

Defined results: null and empty texts consist of the end id alone; documents
with a null id are not stored; rows with one id are stored, placed and read back
one by one, in the order of their roots.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignspark.llm.segments import Numbers, cut, ragged
from alignspark.llm.words import steps

MODEL = "byte_bpe_50k.json"
WINDOW = 16
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 256, 1024, 4096
#: Parts into which the uses of one chunk are dealt out, and how many of them go with its payload.
SALTS, INLINE = 1024, 4
#: Chunks that a task remembers to have sent.
SEEN = 200_000
#: Documents, or hashes of them, that one hash of the manifest's tree covers.
BLOCK = 1024
#: Distinct pieces that a Python worker remembers.
MEMO = 1_000_000
#: Bytes of text that are encoded at a time.
CUT_BYTES = 8_000_000
#: Plain pieces that are encoded as one string.
JOIN = 32
#: A plain piece: a space, then neither white space, controls nor the mark of a special token.
_PLAIN = r"^ [^\x00-\x20\x7F-\x{A0}\pZ<]+$"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces:
    """Ids of the pieces that a Python worker has met: one flat array, and how many ids each piece has."""

    def __init__(self, path: str):
        self.path, self.tok = path, _tokenizer(path)
        self.opens = np.zeros(self.tok.get_vocab_size() + 1, bool)  # tokens that begin with a space
        for token, i in self.tok.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.clear()

    def clear(self) -> None:
        self.names = Numbers(MEMO)
        self.flat, self.size = np.zeros(0, np.uint16 if len(self.opens) <= 65536 else np.uint32), np.zeros(0, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each distinct piece, ids of all pieces by number, how many each has); new pieces are encoded."""
        number, new = self.names.look_up(words)
        if not len(new):
            return number, self.flat, self.size
        plain = pc.match_substring_regex(new, _PLAIN).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        late = number >= self.names.kept
        number[late] = self.names.kept + rank[number[late] - self.names.kept]
        new = new.take(pa.array(order))
        pieces, n = new.to_pylist(), int(plain.sum())
        parts = [self._encoded(pieces[:n], JOIN), self._encoded(pieces[n:], 1)]
        flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
        size = np.concatenate([self.size, *(sizes for _, sizes in parts)])
        stay = len(self.size) + self.names.keep(new)
        self.size = size[:stay]
        self.flat = flat[: len(self.flat) + int(size[len(size) - len(new) : stay].sum())]
        return number, flat, size

    def _encoded(self, pieces: list[str], join: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces, how many each has), encoded ``join`` at a time: where a token begins with a space, the next piece begins."""
        groups = [pieces[i : i + join] for i in range(0, len(pieces), join)]
        coded = [e.ids for e in self.tok.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)] if pieces else []
        ids = np.fromiter(itertools.chain.from_iterable(coded), self.flat.dtype)
        if join == 1:
            return ids, np.fromiter(map(len, coded), np.int64, len(coded))
        edges = np.flatnonzero(self.opens[ids])
        if len(edges) != len(pieces):  # never seen; then every piece is encoded by itself
            return self._encoded(pieces, 1)
        return ids, np.diff(np.append(edges, len(ids)))


@lru_cache(maxsize=2)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def encode(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): ids of all texts one after another, each with the end id, and where each text ends."""
    pieces, first = cut(texts)
    memo = _pieces(path)
    coded = pieces.dictionary_encode()
    number, flat, size = memo.look_up(coded.dictionary)
    pick = number[coded.indices.to_numpy()]
    run = np.concatenate([[0], np.cumsum(size[pick])])
    ends = run[first[1:]] + np.arange(1, len(first))
    ids = np.full(int(run[-1]) + len(first) - 1, end_id, dtype=np.uint32)
    keep = np.ones(len(ids), bool)
    keep[ends - 1] = False
    ids[keep] = flat[ragged(np.cumsum(size) - size, size, pick)]
    return ids, ends


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end: at document ends, and where the rolling hash says so between MIN_CHUNK and MAX_CHUNK ids."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        power, rolled, span = np.uint64(0xD6E8FEB86659FD93), x, 1
        while span < WINDOW:  # the sum of x[i - j] * power^j over the window, doubling the window each time
            shifted = np.zeros_like(rolled)
            shifted[span:] = rolled[:-span] if span < len(rolled) else 0
            rolled = rolled + shifted * power
            power = power * power
            span *= 2
        cuts = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(MEAN_CHUNK - MIN_CHUNK) == 0) + 1
    out, i = [], 0
    at = 0
    cuts = cuts.tolist()
    for end in ends.tolist():
        while at < end:
            low, high = at + MIN_CHUNK, min(at + MAX_CHUNK, end)
            while i < len(cuts) and cuts[i] < low:
                i += 1
            at = cuts[i] if i < len(cuts) and cuts[i] < high else high
            out.append(at)
    return np.array(out, dtype=np.int64)


_USES = "array<struct<doc:bigint,row:bigint,pos:int,offset:bigint,total:bigint,root:string>>"


def write_store(documents: DataFrame, path: str, id_col: str = "doc_id", tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every document and write a store into the folder ``path`` (one that all executors share)."""
    tokenizer = tokenizer or model_path()
    spark = documents.sparkSession
    src = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    wide = 4 if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) > 65536 else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, seen = zstandard.ZstdCompressor(level=1, write_checksum=False), set()
        for big in batches:
            for lo, hi in steps(big.column(1), CUT_BYTES):
                batch = big.slice(lo, hi - lo)
                ids, ends = encode(tokenizer, batch.column(1), end_id)
                stop = chunk_ends(ids, ends)
                start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
                narrow = ids.astype("<u4" if wide == 4 else "<u2")
                doc_end = np.searchsorted(ends, start, side="right")
                doc_start = np.concatenate([[0], ends[:-1]])[doc_end]
                total = ends[doc_end] - doc_start
                docs, row = batch.column(0).to_numpy()[doc_end], batch.column(2).to_numpy()[doc_end]
                new_doc = np.concatenate([[True], doc_end[1:] != doc_end[:-1]])
                number = np.arange(len(start)) - np.maximum.accumulate(np.where(new_doc, np.arange(len(start)), 0))
                found: dict[bytes, list] = {}
                head, hashes = None, []
                for d, w, k, a, b, o, n in zip(docs.tolist(), row.tolist(), number.tolist(), start.tolist(), stop.tolist(), (start - doc_start).tolist(), total.tolist(), strict=True):
                    raw = narrow[a:b].tobytes()
                    key = hashlib.blake2b(raw, digest_size=16).digest()
                    entry = found.get(key)
                    if entry is None:
                        entry = found[key] = [b - a, raw, []]
                    use = {"doc": d, "row": w, "pos": k, "offset": o, "total": n, "root": None}
                    entry[2].append(use)
                    if k == 0:
                        head, hashes = use, []
                    hashes.append(key)
                    if o + b - a == n:
                        head["root"] = hashlib.sha256(b"".join(hashes).hex().upper().encode()).hexdigest()
                # (hash, salt, ids, payload, uses): a payload goes to its hash, once a task; further uses stay spread
                rows = []
                for key, (n, raw, own) in found.items():
                    new = key not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append((key, 0, n, zip_.compress(raw), own[:INLINE]))
                    if rest := own[INLINE:] if new else own:
                        rows.append((key, 1 + rest[0]["row"] % SALTS, n, None, rest))
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), uses)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hash", "salt", "n_ids", "payload", "uses"])

    uses = pa.list_(pa.struct([("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("offset", pa.int64()), ("total", pa.int64()), ("root", pa.string())]))
    met = src.mapInArrow(run, f"hash binary, salt int, n_ids int, payload binary, uses {_USES}")
    # of a chunk's payloads, one a task at most, the first is kept
    first = F.row_number().over(W.partitionBy("hash", "salt").orderBy(F.col("uses")[0]["row"], F.col("uses")[0]["pos"]))
    (
        met.withColumn("n", first)
        .select("hash", "n_ids", F.when(F.col("n") == 1, F.col("payload")).alias("payload"), "uses")
        .write.option("compression", "none").parquet(f"{path}/chunks")
    )
    use = spark.read.parquet(f"{path}/chunks").select(F.explode("uses").alias("u"))
    recipes = use.where("u.pos = 0").select(F.col("u.doc").alias(id_col), F.col("u.total").alias("n_tokens"), F.col("u.root").alias("root"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes.repartitionByRange(n, id_col).sortWithinPartitions(id_col, "root").withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    _summed(spark.read.parquet(f"{path}/recipes"), id_col).coalesce(1).write.parquet(f"{path}/manifest")
    _top(spark.read.parquet(f"{path}/manifest")).withColumn("width", F.lit(wide)).coalesce(1).write.parquet(f"{path}/root")


def _chained(hashes) -> Column:
    """One hash of (number, hash) entries in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(hashes)), lambda x: x["h"]), ","), 256)


def _summed(recipes: DataFrame, id_col: str) -> DataFrame:
    """One row per recipe partition, as the manifest holds it."""
    nth = F.row_number().over(W.partitionBy("part").orderBy(id_col, "root")) - 1
    leaf = F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), "n_tokens", "root"), 256)
    leaves = recipes.select("part", id_col, "n_tokens", nth.alias("nth"), leaf.alias("h")).withColumn("block", F.floor(F.col("nth") / BLOCK))
    blocks = leaves.groupBy("part", "block").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_ids"), F.min(id_col).alias("first_doc"), _chained(F.struct("nth", "h")).alias("h"))
    wide = blocks.withColumn("over", F.floor(F.col("block") / BLOCK)).groupBy("part", "over").agg(F.sum("documents").alias("documents"), F.sum("n_ids").alias("n_ids"), F.min("first_doc").alias("first_doc"), _chained(F.struct("block", "h")).alias("h"))
    return wide.groupBy("part").agg(F.sum("documents").alias("documents"), F.sum("n_ids").alias("n_ids"), F.min("first_doc").alias("first_doc"), _chained(F.struct("over", "h")).alias("roots"))


def _top(manifest: DataFrame) -> DataFrame:
    """The root of the tree: one hash of all partitions' (as many as the writer's tasks)."""
    return manifest.agg(_chained(F.struct("part", F.concat_ws(":", "documents", "n_ids", F.col("first_doc").cast("string"), "roots").alias("h"))).alias("root"))


def _root():
    """Hash of a document's chunk hashes in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("u.pos").alias("pos"), F.hex("hash").alias("h")))), lambda x: x["h"]), ""), 256)


def _poly_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 parts moved in front of n further bytes: the xor of a message's moved parts is its CRC-32."""
    n, out = n_bytes.astype(np.int64).copy(), crc.astype(np.uint64)
    power = np.array([1 << 23], dtype=np.uint64)  # x^8
    while n.any():
        out = np.where(n & 1, _poly_times(out, np.broadcast_to(power, out.shape)), out)
        power = _poly_times(power, power)
        n >>= 1
    return out


def id_width(spark: SparkSession, path: str) -> int:
    """Bytes of one stored id, as the store says; a store whose top root does not fit its manifest raises."""
    root = spark.read.parquet(f"{path}/root").collect()
    now = _top(spark.read.parquet(f"{path}/manifest")).first()["root"]
    if len(root) != 1 or root[0]["root"] != now:
        raise ValueError("the manifest does not match the store's root")
    return root[0]["width"]


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every stored document, from the store's files.

    Each chunk is read once, checked against its hash and summed up; recipes
    put the sums together.  A document whose chunks do not give its root and
    length, chunks without a recipe, or a partition that disagrees with the
    manifest (also one that is missing on either side) raises; so does, at once,
    a manifest that does not give the root.
    """
    narrow = id_width(spark, path) == 2
    stored = spark.read.parquet(f"{path}/chunks")
    payloads = stored.where(F.col("payload").isNotNull()).select("hash", "n_ids", "payload")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            crc = []
            for key, n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = _ids(key, n, payload, narrow)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], names=["hash", "crc"])

    @F.pandas_udf("bigint")
    def moved(crc, n_bytes):
        import pandas as pd

        return pd.Series(crc_shift(crc.to_numpy(), n_bytes.to_numpy()).astype(np.int64))

    checked = payloads.mapInArrow(sums, "hash binary, crc bigint")
    use = stored.select("hash", "n_ids", F.explode("uses").alias("u")).join(checked, "hash")
    docs = (
        use.withColumn("part_crc", moved("crc", (F.col("u.total") - F.col("u.offset") - F.col("n_ids")) * 4))
        .groupBy(F.col("u.doc").alias("doc_read"), F.col("u.row").alias("row"))
        .agg(F.sum("n_ids").alias("n_read"), F.bit_xor("part_crc").alias("ids_crc32"), _root().alias("root_read"))
    )
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = spark.read.parquet(f"{path}/manifest")
    # one row per recipe partition, as many as the writer's partitions: their running sum is small
    before = parts.select("part", (F.sum("n_ids").over(W.orderBy("first_doc").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    in_order = W.partitionBy("part").orderBy(id_col, "root").rowsBetween(W.unboundedPreceding, -1)
    placed = recipes.withColumn("within", F.sum("n_tokens").over(in_order)).withColumn("copy", F.row_number().over(W.partitionBy(id_col).orderBy("root")))
    docs = docs.withColumn("copy_read", F.row_number().over(W.partitionBy("doc_read").orderBy("root_read", "row")))
    now = _summed(recipes, id_col)
    same = F.coalesce((F.col("m.documents") == F.col("r.documents")) & (F.col("m.n_ids") == F.col("r.n_ids")) & (F.col("m.first_doc") == F.col("r.first_doc")) & (F.col("m.roots") == F.col("r.roots")), F.lit(False))
    sound = parts.alias("m").join(now.alias("r"), "part", "full").select("part", same.alias("same"), F.col("r.documents").isNull().alias("gone"))
    lost = sound.where("gone").select(*[F.raise_error(F.concat(F.lit("the manifest has a partition without recipes: "), F.col("part").cast("string"))).cast("bigint").alias(c) for c in (id_col, "start", "n_tokens", "ids_crc32")])
    placed = placed.join(F.broadcast(before.join(sound, "part", "full")), "part", "left")
    good = (F.col("root") == F.col("root_read")) & (F.col("n_tokens") == F.col("n_read"))
    name = F.coalesce(F.col(id_col), F.col("doc_read"))
    fails = lambda text, x: F.raise_error(F.concat(F.lit(text), x.cast("string"))).cast("bigint")
    return placed.join(docs, (F.col(id_col) == F.col("doc_read")) & (F.col("copy") == F.col("copy_read")), "full").select(
        F.when(~F.coalesce(good, F.lit(False)), fails("document does not match its recipe: ", name))
        .when(~F.coalesce("same", F.lit(False)), fails("recipes do not match the manifest, partition ", F.col("part"))).otherwise(F.col(id_col)).alias(id_col),
        (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))).cast("bigint").alias("start"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("ids_crc32").cast("bigint").alias("ids_crc32"),
    ).unionByName(lost)


def _ids(key: bytes, n: int, payload: bytes, narrow: bool) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    if hashlib.blake2b(raw, digest_size=16).digest() != bytes(key):
        raise ValueError(f"chunk {bytes(key).hex()} does not match its hash")
    ids = np.frombuffer(raw, dtype="<u2" if narrow else "<u4")
    if len(ids) != n:
        raise ValueError(f"chunk {bytes(key).hex()} has {len(ids)} ids, not {n}")
    return ids


def read_documents(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The full id arrays of chosen documents: (id, ids array<int>), one row for each stored row."""
    narrow = id_width(spark, path) == 2
    stored = spark.read.parquet(f"{path}/chunks")
    wanted = stored.select("hash", F.explode("uses").alias("u")).select("hash", F.col("u.doc").alias(id_col), F.col("u.row").alias("row"), F.col("u.pos").alias("pos")).join(ids.select(id_col).distinct(), id_col, "left_semi")
    payloads = stored.where(F.col("payload").isNotNull()).select("hash", "n_ids", "payload")

    @F.pandas_udf("array<int>")
    def opened(parts):
        import pandas as pd

        return pd.Series([np.concatenate([_ids(x["hash"], x["n_ids"], x["payload"], narrow) for x in p]).astype(np.int32) for p in parts])

    rows = wanted.join(payloads, "hash").groupBy(id_col, "row").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "n_ids", "payload"))).alias("parts"))
    return rows.select(id_col, opened("parts").alias("ids"))
