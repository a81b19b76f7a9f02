"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become arrays of words.  Of every run of ``GRAM`` words a hash is taken,
and of every ``SPAN`` such hashes in a row the least is kept, with its place
(the leftmost of equal ones).  A shared passage of GRAM + SPAN - 1 words holds a
whole span on both sides, so both keep the same hash at the same place of it:
no shared window of ten words is missed.  Documents and items meet by kept
hash.  Each meeting is extended to the windows of the document that hold it,
and these are compared with the items' windows word for word.  Items shorter
than a window are one window; for each length that occurs all runs of that
length are kept, in the same pass over the documents.

The documents' side never leaves its task before it has met an item.  The
items' fingerprints and windows are sent to every executor if they are counted
to be at most ``BROADCAST_ROWS``; beyond that both sides are shuffled by hash.
Items' prints and windows are joined as sets, so a document of one word
repeated costs as much as any other of its length.

Defined results: null and empty texts have no words, no hits and no items;
items without words match nothing; rows with one id share their findings; a row
with a null id is known by its text instead, and so is judged by that alone;
extra columns are ignored, or kept as they are; with an empty benchmark nothing
is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignspark.llm.common import broadcast_if_small, materialize

WINDOW = 10
GRAM, SPAN = 5, 6
#: Low bits of a kept value that hold its place; the others hold the hash.
PLACE_BITS = 28
BROADCAST_ROWS = 1_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case.  Null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def _grams(hashes: Column, n: int) -> Column:
    """Hash and place of each run of n word hashes, in one integer."""
    runs = F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    return F.transform(runs, lambda x, i: F.shiftleft(F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, n))), PLACE_BITS).bitwiseOR(i.cast("bigint")))


def _least(grams: Column, n: int) -> Column:
    """The distinct least values of each n in a row."""
    if n == 1:
        return grams
    runs = F.slice(grams, 1, F.greatest(F.size(grams) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(runs, lambda x, i: F.least(x, *(F.get(grams, i + k) for k in range(1, n)))))


def fingerprints(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, n, print, place) of all that is kept of rows with ``words``, for windows of each length in one pass.

    For full windows prints are winnowed; for shorter ones every run is kept.
    """
    size = {n: (GRAM, SPAN) if n == WINDOW else (n, 1) for n in lengths}
    hashed = rows.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    # each step in a select of its own: what is used several times is computed once
    grams = hashed.select(key, *(_grams(F.col("hashes"), gram).alias(f"grams{n}") for n, (gram, _) in size.items()))
    kept = grams.select(key, *(_least(F.col(f"grams{n}"), span).alias(f"kept{n}") for n, (_, span) in size.items()))
    marked = lambda n: F.transform(f"kept{n}", lambda k: F.struct(F.lit(n).alias("n"), k.alias("kept")))
    each = kept.select(key, F.explode(F.concat(*map(marked, lengths))).alias("x")).select(key, "x.n", "x.kept")
    return each.select(key, "n", F.shiftright("kept", PLACE_BITS).alias("print"), F.col("kept").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("place"))


def _doc() -> Column:
    """What a document is known by: its id, or where that is null the digest of its text.  It is never null itself."""
    return F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest")).alias("doc")


def _windows(starts: Column, n: Column) -> Column:
    """(start, window) of windows of n of a row's ``words``, a window as its words with blanks between."""
    return F.transform(starts, lambda p: F.struct(p.alias("start"), F.array_join(F.slice("words", p + 1, n), " ").alias("window")))


def item_windows(items: DataFrame) -> DataFrame:
    """(n, window, item_id): the windows of all items, each once an item."""
    rows = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    every = F.sequence(F.lit(0), F.size("words") - F.col("n"))
    return rows.select("n", "item_id", F.explode(_windows(every, F.col("n"))).alias("w")).select("n", "w.window", "item_id").distinct()


def hits(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, start, n, window), (n, window, item_id)): every window of a document that is one of an item, and the items' windows.

    A document's print that an item has, too, is extended to the windows that
    hold it.  Prints and windows of items are joined without places and items,
    so a repeated one costs a document one row a place, not one a pair of places.
    """
    of_items = materialize(item_windows(items), "benchmark-windows")
    lengths = [r[0] for r in of_items.select("n").distinct().orderBy("n").collect()]  # ten values at most
    docs = documents.select(_doc(), words(F.col("text")).alias("words"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not lengths:
        return documents.sparkSession.createDataFrame([], f"doc struct<doc_id:{kind},digest:string>, start int, n int, window string"), of_items
    small = broadcast_if_small(materialize(_item_prints(items, lengths), "benchmark-prints"), BROADCAST_ROWS)
    met = fingerprints(docs, "doc", lengths).join(small, ["n", "print"], "left_semi")
    # a full window holds its kept gram at one of SPAN places; a shorter one is its own gram
    back = F.when(F.col("n") == WINDOW, SPAN - 1).otherwise(0)
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(p - back, F.lit(0)), p))))
    # at most as many entries as a document has words
    met = met.groupBy("doc", "n").agg(F.collect_set("place").alias("places")).select("doc", "n", starts.alias("starts"))
    met = materialize(met, "benchmark-meetings")
    hit_docs = docs.join(broadcast_if_small(met.select("doc").distinct(), BROADCAST_ROWS), "doc", "left_semi")
    tried = hit_docs.join(met, "doc").select("doc", "n", F.explode(_windows(F.col("starts"), F.col("n"))).alias("w")).select("doc", "n", "w.start", "w.window")
    known = broadcast_if_small(of_items.select("n", "window").distinct(), BROADCAST_ROWS)
    return tried.join(known, ["n", "window"], "left_semi").select("doc", "start", "n", "window"), of_items


def _item_prints(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(n, print): what is kept of all items, for windows of their own length."""
    rows = items.select(words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("own", F.least(F.size("words"), F.lit(WINDOW)))
    return fingerprints(rows.select(F.struct("own").alias("k"), "words"), "k", lengths).where("n = k.own").select("n", "print").distinct()


def contamination(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), items_sha256 and contaminated of every document."""
    found, of_items = hits(documents, items)
    found = materialize(found, "benchmark-hits")
    covered = found.select("doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place")).distinct()
    n_hit = covered.groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    # as many entries as the benchmark has items, at most
    pairs = found.select("doc", "n", "window").distinct().join(broadcast_if_small(of_items, BROADCAST_ROWS), ["n", "window"])
    which = pairs.select("doc", F.col("item_id").cast("string").alias("item")).groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = documents.select(_doc(), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = rows.join(n_hit.join(which, "doc", "full"), "doc", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc.doc_id", "n_words", n.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"), items_.alias("items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with the columns that they came with."""
    found = materialize(hits(documents, items)[0].select("doc").distinct(), "contaminated-ids")
    key = "contaminated_key"
    while key in (c.lower() for c in documents.columns):
        key += "_"
    mark = documents.select("*", _doc().alias(key))
    gone = broadcast_if_small(found.withColumnRenamed("doc", key), BROADCAST_ROWS)
    return mark.join(gone, key, "left_anti").select([F.col(f"`{c}`") for c in documents.columns])


#: The same result in DuckDB.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), ix AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)
), dx AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM ix) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item_id, p, n FROM dx JOIN ix USING (n, s)
), pos AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
