"""Interaction of document filters: what each removes, alone and behind the others, in every order of application.

A relational word pipeline.  Texts are dealt out by document, words exploded and
counted by (document, word), and those rows by document: total and distinct
words, with no shuffle of words.  The other conditions are columns of the
document's row; the first id of each text comes from a grouping by digest.
Outer joins bring all together as one mask of five bits a document, and one
aggregation a part counts documents by mask: 32 conditional counts, and as many
of good and of toxic ones.  Every figure of every order follows from these.

Filters (a document fails): A under 200 words; B under half of its words are
distinct; C over 2 % of its code points are A-Z; D holds one of ``#$%&*|``; E
its text is that of a document of smaller id.

Defined results: a null text is the empty one, a null source the empty part; a
document of no words fails A alone of A and B; rows that share an id and a text
are one document each and no copies of each other; a null id is not smaller
than any and has no label; labels of one id count if any of them says so; an
empty table has no parts; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alignspark.llm.common import BROADCAST_IDS, broadcast_if_small, drop_table, let_go, materialize

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Copies of a text from which on its first id is sent to all tasks instead of being joined by shuffle.
HUB = 1000

_BLANKS = r"[\x20\x09-\x0D]+"
#: Documents that one task counts the words of, so that its table of words stays in a core's cache; tasks are MOST_TASKS at most, beyond that they grow.
DOCS_PER_TASK = 500
MOST_TASKS = 20_000


def word_totals(texts: DataFrame) -> DataFrame:
    """(doc_id, twin, total, different): words, and distinct words, of all texts of an id that are alike; none without words."""
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, texts.count() // DOCS_PER_TASK))
    dealt = texts.repartition(tasks, "doc_id", "twin")
    words = dealt.select("doc_id", "twin", F.explode(F.split("text", _BLANKS)).alias("word")).where("word != ''")
    each = words.groupBy("doc_id", "twin", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("doc_id", "twin").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different"))


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def masks(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(part, mask, docs, good, toxic), documents that are alike in one row, and the written tables that it reads."""
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    texts = texts.withColumn("twin", F.xxhash64("text"))
    n = F.char_length("text")
    rows = texts.select(
        "doc_id", "twin", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * (F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))) > 2 * n).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("docs"))
    rows = materialize(rows, "audit-rows")
    totals = materialize(word_totals(texts.select("doc_id", "twin", "text")), "audit-words")
    # how often the words of one text were counted: once for each row of its id
    alike = W.partitionBy("doc_id", "twin")
    rows_ = rows.withColumn("times", F.sum("docs").over(alike))
    same = rows_["doc_id"].eqNullSafe(totals["doc_id"]) & (rows_["twin"] == totals["twin"])
    flagged = rows_.join(totals.select("doc_id", "twin", "total", "different"), same, "left").select(
        rows_["doc_id"], "part", "digest", "c", "d", "docs", "times", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("different", F.lit(0)).alias("different")
    )
    first = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("docs").alias("copies")).where("copies > 1"), "audit-first")
    hubs = first.where(F.col("copies") >= HUB).select("digest", F.col("first").alias("hub"))
    rest = first.where(F.col("copies") < HUB).select("digest", "first")
    flagged = flagged.join(broadcast_if_small(hubs, BROADCAST_IDS), "digest", "left")
    # the digests of hubs are no keys of the shuffle: those rows are dealt out by their ids
    flagged = flagged.withColumn("key", F.when(F.col("hub").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2(F.concat_ws(":", F.lit("hub"), "doc_id"), 256))))
    flagged = flagged.join(rest.withColumnRenamed("digest", "key"), "key", "left")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1)).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1)).alias("toxic"))
    flagged = flagged.join(marks, "doc_id", "left")
    conditions = {
        "A": F.col("total") < 200 * F.col("times"), "B": 100 * F.col("different") * F.col("times") < 50 * F.col("total"), "C": F.col("c"), "D": F.col("d"),
        "E": F.coalesce(F.col("doc_id") > F.coalesce("hub", "first"), F.lit(False)),
    }
    mask = sum((F.when(v, _bit(k)).otherwise(0) for k, v in conditions.items()), F.lit(0))
    return flagged.select("part", mask.alias("mask"), "docs", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), [rows, totals, first]


def conditional_counts(flagged: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of the number of documents by mask."""

    def by_mask(wanted: Column | None) -> Column:
        return F.array(*(F.sum(F.when((F.col("mask") == m) & wanted if wanted is not None else F.col("mask") == m, F.col("docs")).otherwise(0)) for m in range(MASKS)))

    return flagged.groupBy("part").agg(by_mask(None).alias("n"), by_mask(F.col("good")).alias("good"), by_mask(F.col("toxic")).alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step, from the counts by mask."""
    steps = counts.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(o)) for o in permutations(FILTERS))))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    own = sum((F.when(letter == x, _bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    before = sum((F.when(F.contains(earlier, F.lit(x)), _bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    steps = steps.withColumns({"letter": letter, "own": own, "before": before})

    def over(counted: str, wanted) -> Column:
        """The sum of counts whose mask is wanted."""
        return F.aggregate(F.transform(counted, lambda x, m: F.when(wanted(m), x).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    rows = steps.select(
        "part", "filter_order", "step", "letter",
        over("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), over("n", here).alias("removed"), over("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        over("n", lambda m: m == F.col("own")).alias("unique_fails"), over("good", here).alias("good_lost"), over("toxic", here).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: see the module."""
    flagged, written = masks(documents, labels)
    counts = materialize(conditional_counts(flagged), "audit-counts")
    for df in written:
        drop_table(df)
    let_go(documents.sparkSession)
    return orders(counts)


#: The same result in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents
), w AS (
  SELECT r, len(ws) AS total, len(list_distinct(ws)) AS different FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    {'A': total < 200, 'B': 100 * different < 50 * total, 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
     'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), FALSE)} AS x
  FROM d JOIN w USING (r) LEFT JOIN l ON l.doc_id = d.doc_id
), m AS (
  SELECT part, good, toxic, concat(CASE WHEN x.A THEN 'A' ELSE '' END, CASE WHEN x.B THEN 'B' ELSE '' END, CASE WHEN x.C THEN 'C' ELSE '' END, CASE WHEN x.D THEN 'D' ELSE '' END, CASE WHEN x.E THEN 'E' ELSE '' END) AS failed FROM f
), c AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, left(filter_order, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), t AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT contains(failed, own) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, own) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""
