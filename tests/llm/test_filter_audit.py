import re
from itertools import permutations

from alignspark.llm import filter_audit as fa
from alignspark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, word string, part int, mask string"


def plain(docs, labels):
    """Every order applied document by document."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, t, source in docs:
        t = t or ""
        words = WORD.findall(t)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in docs),
        }
        rows.append((source or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                out_now = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                redundant = sum(x in r[1] for r in rows if r[0] == part) - len(out_now)
                unique = sum(r[1] == {x} for r in rows if r[0] == part)
                out[part, order, step] = [len(left), len(out_now), redundant, unique, sum(r[2] for r in out_now), sum(r[3] for r in out_now)]
                shares[part, x] = shares.get((part, x), 0) + len(out_now)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def check(spark, docs, labels):
    d = spark.createDataFrame([(*x, "w", 1, "m") for x in docs], DOCS)
    got = fa.audit(d, spark.createDataFrame([(*x, "y", 0) for x in labels], "doc_id long, quality int, toxic int, text string, digest int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    want = plain(docs, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == want and len(rows) == len(want)


def test_equals_brute_force(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(250))
    docs = [
        (1, long, "a"), (2, long, "a"), (3, long, None), (4, long + " X" * 90, "a"), (5, "again " * 400, "b"), (6, "again " * 400, "b"), (7, long + " 5%", ""), (8, None, "b"),
        (9, "", "a"), (10, " \t\n\r\x0b ", "a"), (11, "x\x1cy", "a"), (12, "É" * 30, "c"), (13, "word " * 100_000, "c"), (None, long, "a"), (None, None, None), (None, long, "a"),
        (14, "AB" + "c" * 98, "d"), (15, "ABC" + "c" * 97, "d"), (16, long.replace("w7 ", "W7 "), "d"), (1, long, "a"), (1, "another", "a"), (17, " ".join(["x"] * 100 + [f"y{k}" for k in range(100)]), "d"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (8, None, 1), (None, 1, 1), (99, 1, 1), (16, 1, None)]
    check(spark, docs, labels)
    monkeypatch.setattr(fa, "HUB", 2)
    check(spark, docs, labels)
    check(spark, docs[:3], [])


def test_empty_tables(spark):
    empty = fa.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def test_table(spark, sf):
    rows = fa.audit(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == plain(docs, [tuple(r) for r in table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()])


def test_hot_text_meets_no_shuffle_by_its_digest(spark, monkeypatch):
    """Copies of one text beyond HUB are dealt out by their ids."""
    monkeypatch.setattr(fa, "HUB", 50)
    docs = [(i, "the same text", f"s{i % 3}") for i in range(300)]
    d = spark.createDataFrame([(*x, "w", 1, "m") for x in docs], DOCS)
    rows = fa.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").collect()
    assert sorted((r.part, r.kept, r.removed) for r in rows) == [("s0", 1, 99), ("s1", 0, 100), ("s2", 0, 100)]
