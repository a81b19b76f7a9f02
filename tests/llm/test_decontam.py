import hashlib
import random
import re
import time

from alignspark.llm import decontam
from alignspark.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    lengths = {len(k) for k in windows}
    out = {}
    for i, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[k]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, item_id string, place int")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(d, b).collect()}
    want = plain(docs, items)
    for i in want:
        assert got[i] == want[i], (i, got[i], want[i])
    assert len(got) == len(want)
    kept = {r.doc_id for r in decontam.drop_contaminated(d, b).collect()}
    assert kept == {i for i, v in want.items() if not v[4]}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "Ab", "é", "É", "c3", "中"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 15, 40]))) for k in range(14)] + [(20, None), (21, ""), (22, " - "), (23, "a a a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        t = text(rng.choice([0, 2, 9, 12, 60]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(w))
            t += " ".join(w[a : a + rng.choice([5, 12, 50])]) + " " + text(3)
        docs.append((i, t))
    docs += [(90, None), (91, "a " * 3000), (92, "b" * 100_000)]
    check(spark, docs, items)
    check(spark, docs, [x for x in items if x[0] not in (0, 1)] and [(5, "b c3 é a a b 中 c3 c3 a a b b ab ab c3")])
    check(spark, docs, [])
    check(spark, [], items)


def test_rows_that_share_an_id(spark):
    d = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "y"), (7, "y z"), (7, "y")], "item_id long, text string")
    rows = decontam.contamination(d, b).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in rows) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]
    more = d.unionByName(spark.createDataFrame([(None, "clean"), (None, None)], "doc_id long, text string"))
    assert sorted((r.text or "") for r in decontam.drop_contaminated(more, b).collect()) == ["", "clean"]


def test_table(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, items).collect()}
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(v[4] for v in got.values())


def test_repeated_words_cost_no_more_than_others(spark):
    """Every window of both equals every other: places are found in seconds, and exactly."""
    items = [(1, "again " * 1000), (2, "again and " * 500), (3, "again")]
    docs = [(1, "again " * 20_000), (2, "and again " * 10_000), (3, "again " * 9), (4, "and " * 9)]
    begun = time.time()
    check(spark, docs, items)
    assert time.time() - begun < 60


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "x y z", "a", 1, "b", 2), (2, "clean", "c", 3, "d", 4)], "doc_id long, text string, contaminated_key string, n int, window string, `_contaminated_key` int")
    b = spark.createDataFrame([(7, "y z", "k", 1)], "item_id long, text string, window string, n int")
    got = decontam.drop_contaminated(d, b)
    assert got.columns == d.columns and [tuple(r) for r in got.collect()] == [(2, "clean", "c", 3, "d", 4)]
    assert {r.doc_id: r.n_hit for r in decontam.contamination(d, b).collect()} == {1: 2, 2: 0}
