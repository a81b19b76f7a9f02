"""Licence scans in DataFrame functions only.

Three kinds of units of a text are compared with templates by the cosine of
sparse TF-IDF vectors: statements (lines, and sentences within lines) that hold
an anchor word (licence, copyright, SPDX, warranty ...; every template holds
one); blocks, that is runs of neighbouring paragraphs that hold one each; and
the whole of every text that holds one.  Templates are one-line grants, the
usual notices at the head of source files, and whole licence texts
(``license_texts/``).  Word weights come from the templates: idf =
ln((1 + templates) / (1 + templates with the word)) + 1, a word that no template
has weighs the most.  A unit is a header if its best cosine reaches
``threshold``; the text takes its best header, one that merely reserves all
rights only if there is no other.  A file is a licence file if its name says so
or if half of its words or more stand in such statements, or in such blocks; it
speaks for its directory.  A file without a header of its own inherits from the
nearest ancestor directory that has a licence file, found by joining directories
with all their ancestors.

What is small by definition (the templates) is sent to every executor; equal
units are scored once.  Directories are resolved once each and then joined to
their files, so a directory with a third of all files costs one row.

Defined results: null and empty texts have no header; a null path has no
directory and inherits nothing; rows with one id share their header, and a row
with a null id is known by its text; between equal cosines the first licence
name wins; of several licence files in a directory the one with the highest
cosine, then the first name.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import broadcast_if_small, materialize

THRESHOLD = 0.6
#: Words by which a statement can be about a licence at all.
ANCHORS = r"(?i)licen[cs]|copyright|copyleft|spdx|public domain|all rights reserved|permission|redistribut|warrant|liab|free software|as[ -]is|restriction|altered source"
#: Where paragraphs end: at lines without a letter or digit.
PARAGRAPHS = r"\n(?:[^A-Za-z0-9\n]*\n)+"
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"

# Statements and notices by which licences are granted.
GRANTS: list[tuple[str, str]] = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "licensed under the ISC License"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "released into the public domain by the Unlicense"),
    ("proprietary", "Copyright all rights reserved"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this program. If not, see http://www.gnu.org/licenses/") for name, kind, version, mark in (
        ("AGPL-3.0", "Affero General Public License", "3", ":"), ("GPL-2.0", "General Public License", "2", ";"), ("GPL-3.0", "General Public License", "3", ":"),
        ("LGPL-2.1", "Lesser General Public License", "2.1", ";"), ("LGPL-3.0", "Lesser General Public License", "3", ":"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
]


def _texts() -> list[tuple[str, str]]:
    """(licence, its whole text), in the order of names."""
    return [(path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


TEMPLATES: list[tuple[str, str]] = GRANTS + _texts()


def terms(text: Column) -> Column:
    """Words of a statement: runs of ASCII letters, digits and inner dots or hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def template_vectors(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, float]:
    """((license, number, term, weight) of unit vectors with each term's idf, the idf of unknown words)."""
    import math

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license string, statement string")
    tf = rows.select("template", "license", F.explode(terms(F.col("statement"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1 + len(templates)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weighed = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, "template").select("template", "license", "term", "idf", (F.col("w") / F.col("norm")).alias("weight")), math.log(1 + len(templates)) + 1


def statements(text: Column) -> Column:
    """The statements of a text that hold an anchor word."""
    return F.filter(F.split(text, r"\n|(?<=[.!?;])\s"), lambda s: s.rlike(ANCHORS))


def blocks(text: Column) -> Column:
    """The runs of neighbouring paragraphs that hold an anchor word each; runs of one line are statements already."""
    state = lambda done, run: F.struct(done.alias("done"), run.alias("run"))

    def step(acc: Column, part: Column) -> Column:
        grown = F.when(acc["run"] == "", part).otherwise(F.concat_ws("\n", acc["run"], part))
        return F.when(part.rlike(ANCHORS), state(acc["done"], grown)).otherwise(state(F.when(acc["run"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["run"])), F.lit("")))

    parts = F.concat(F.split(text, PARAGRAPHS), F.array(F.lit("")))  # the last one ends every run
    found = F.aggregate(parts, state(F.array().cast("array<string>"), F.lit("")), step, lambda acc: acc["done"])
    return F.filter(found, lambda b: b.contains("\n"))


def score_statements(found: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(unit, license, score, n_terms): the best template of each distinct unit of ``found`` (unit, statement).

    ``unit`` is a digest: one shuffle brings equal units together, and all that follows stays where they are.
    """
    vectors, unknown = template_vectors(found.sparkSession, templates)
    vectors = F.broadcast(materialize(vectors, "license-templates"))  # one row a word of the templates
    words = F.broadcast(vectors.select("term", "idf").distinct())
    once = found.groupBy("unit").agg(F.first("statement").alias("statement"))
    tf = once.select("unit", F.explode(terms(F.col("statement"))).alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(words, "term", "left").select("unit", "term", "tf", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    norm = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n_terms"))
    dots = weighed.join(vectors.drop("idf"), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = dots.groupBy("unit", "license").agg(F.max("dot").alias("dot"))
    return best.join(norm, "unit").groupBy("unit").agg(
        F.min(F.struct((-F.round(F.col("dot") / F.col("norm"), 6)).alias("s"), F.col("license").alias("l"))).alias("b"), F.first("n_terms").alias("n_terms")
    ).select("unit", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"), "n_terms")


def directory(path: Column) -> Column:
    """The directory of a path without its last part; null where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def ancestors(folder: Column) -> Column:
    """A directory and all above it, as (ancestor, depth)."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("ancestor"), n.alias("depth")))


def scan(files: DataFrame, id_col: str, path: Column, text: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """id, license, score, origin ('header', 'file', 'inherited' or 'none') and inherited_from of every file."""
    body = F.col(text).cast("string")
    key = F.struct(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.sha2(body, 256)).alias("digest"))
    rows = files.select(key.alias("id"), path.alias("path"), body.alias("text"))
    units = F.array(
        *(F.struct(F.lit(kind).alias("kind"), parts.alias("parts")) for kind, parts in (("line", statements(F.col("text"))), ("block", blocks(F.col("text"))), ("whole", F.array("text")))),
    )
    said = rows.where(F.col("text").rlike(ANCHORS)).select("id", F.explode(units).alias("u")).select("id", "u.kind", F.explode("u.parts").alias("statement"))
    said = materialize(said.select("id", "kind", F.unhex(F.md5("statement")).alias("unit"), "statement"), "license-statements")
    scored = materialize(score_statements(said, templates).where(F.col("score") >= threshold), "license-scores")
    words_in = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_terms"))), F.lit(0))
    own = (
        said.select("id", "kind", "unit").join(scored, "unit").groupBy("id")
        .agg(F.min(F.struct((F.col("license") == "proprietary").alias("p"), (-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b"), F.greatest(*map(words_in, ("line", "block", "whole"))).alias("said"))
        .select("id", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"), "said")
    )
    own = materialize(own, "license-headers")
    stated = broadcast_if_small(own, 200_000)
    # whole texts are counted only where a header was found
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES), F.lit(False))
    held = rows.join(stated, "id").select("id", directory(F.col("path")).alias("folder"), "license", "score", (named | (F.col("said") * 2 >= F.size(terms(F.col("text"))))).alias("is_file"))
    held = materialize(held, "license-holders")
    speaks = held.where("is_file and folder is not null").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b")).select(F.col("folder").alias("ancestor"), F.col("b.l").alias("from_license"), (-F.col("b.s")).alias("from_score"))
    folders = rows.select(directory(F.col("path")).alias("folder")).where("folder is not null").distinct()
    nearest = (
        folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.ancestor", "a.depth")
        .join(speaks, "ancestor").groupBy("folder").agg(F.max(F.struct("depth", "ancestor", "from_license", "from_score")).alias("n"))
        .select("folder", F.col("n.ancestor").alias("inherited_from"), F.col("n.from_license").alias("from_license"), F.col("n.from_score").alias("from_score"))
    )
    nearest = broadcast_if_small(materialize(nearest, "license-folders"), 100_000)
    mine = held.groupBy("id").agg(F.first("license").alias("license"), F.first("score").alias("score"), F.max("is_file").alias("is_file"))
    out = rows.select("id", directory(F.col("path")).alias("folder")).join(broadcast_if_small(materialize(mine, "license-own"), 200_000), "id", "left").join(nearest, "folder", "left")
    header = F.col("license").isNotNull()
    return out.select(
        F.col("id.id").alias(id_col),
        F.when(header, F.col("license")).otherwise(F.col("from_license")).alias("license"),
        F.when(header, F.col("score")).otherwise(F.col("from_score")).alias("score"),
        F.when(header, F.when(F.col("is_file"), F.lit("file")).otherwise(F.lit("header"))).when(F.col("from_license").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(~header, F.col("inherited_from")).alias("inherited_from"),
    )


def document_path() -> Column:
    """Documents have no path of their own: source, language and id stand for one."""
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan of ``documents`` in DuckDB (ids not null)."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, '{a}', {quoted(b)})" for i, (a, b) in enumerate(templates))
    anchors, names = ANCHORS, FILE_NAMES
    words = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
    return f"""
WITH tpl(template, license, body) AS (VALUES {rows}),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({words.format('body')}) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1 + {len(templates)}) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tv AS (SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
an AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '{anchors}')),
ln AS (SELECT doc_id, statement FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\x0B\\f\\r]', E'\\\\1\\n', 'g'), E'\\n')) AS statement FROM an) WHERE regexp_matches(statement, '{anchors}')),
pa AS (SELECT doc_id, p, unnest(parts[p : p]) AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS p FROM (SELECT doc_id, string_split_regex(text, '{PARAGRAPHS}') AS parts FROM an))),
isl AS (SELECT doc_id, p, part, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM pa WHERE regexp_matches(part, '{anchors}')),
bl AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY p) AS statement FROM isl GROUP BY doc_id, island),
st AS (SELECT doc_id, 'line' AS kind, statement FROM ln UNION ALL SELECT doc_id, 'block', statement FROM bl WHERE contains(statement, chr(10)) UNION ALL SELECT doc_id, 'whole', text FROM an),
sw AS (SELECT statement, term, count(*) AS tf FROM (SELECT statement, unnest({words.format('statement')}) AS term FROM (SELECT DISTINCT statement FROM st)) GROUP BY ALL),
sv AS (SELECT statement, term, tf, tf * coalesce(idf, ln(1 + {len(templates)}) + 1) AS w FROM sw LEFT JOIN idf USING (term)),
sn AS (SELECT statement, sqrt(sum(w * w)) AS norm, sum(tf) AS n_terms FROM sv GROUP BY statement),
sc AS (SELECT statement, license, round(max(dot) / any_value(norm), 6) AS score, any_value(n_terms) AS n_terms FROM (SELECT statement, template, license, sum(w * weight) AS dot FROM sv JOIN tv USING (term) GROUP BY ALL) JOIN sn USING (statement) GROUP BY statement, license),
sb AS (SELECT * FROM sc WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY statement ORDER BY score DESC, license) = 1),
hits AS (SELECT doc_id, kind, license, score, n_terms FROM st JOIN sb USING (statement)),
sums AS (SELECT doc_id, max(s) AS said FROM (SELECT doc_id, kind, sum(n_terms) AS s FROM hits GROUP BY ALL) GROUP BY doc_id),
dh AS (SELECT doc_id, license, score, said FROM (SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY license = 'proprietary', score DESC, license) AS r FROM hits) JOIN sums USING (doc_id) WHERE r = 1),
fo AS (SELECT doc_id, coalesce(source, '_') AS top, coalesce(source, '_') || '/' || coalesce(lang, '_') AS folder, license, score, regexp_matches(CAST(doc_id AS VARCHAR), '{names}') OR said * 2 >= len({words.format("coalesce(text, '')")}) AS is_file FROM documents LEFT JOIN dh USING (doc_id)),
sp AS (SELECT folder, license, score FROM fo WHERE license IS NOT NULL AND is_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, license) = 1)
SELECT fo.doc_id, coalesce(fo.license, sp.license) AS license, coalesce(fo.score, sp.score) AS score,
       CASE WHEN fo.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN sp.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN fo.license IS NULL THEN sp.folder END AS inherited_from
FROM fo LEFT JOIN sp ON sp.folder = fo.folder
"""
