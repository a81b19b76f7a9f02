import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from alignspark.llm import spelling as sp
from alignspark.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = plain_words(docs)
    near = {w: [x for x in n if differ_by_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def check(spark, docs):
    d = spark.createDataFrame([(*x, "r", 5) for x in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = sp.variants(d)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(docs)
    return rows


def corpus(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abàÿ") for _ in range(rng.choice([6, 7, 8, 9, 13]))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaaaa", "abababab"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.choice([0, 5, 40])):
            w = rng.choice(bases[: rng.choice([3, 43])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÉ") + w[k:], w[:k] + rng.choice("abcß") + w[k + 1 :], w.capitalize()])
            words.append(w)
        docs.append((i, rng.choice([" ", "-", "\n", "3"]).join(words)))
    return [*docs, (None, "abababab ababäbab"), (None, None), (70, ""), (71, "Ārāmāsia × aaaaaaaa÷aaaaaaaa"), (72, "aaaaaaaa " * 3000), (72, "aaaaaaaa " * 3000), (73, " ".join("x" * k for k in (30, 30, 31, 31)))]


@pytest.mark.parametrize("group,letters", [(20_000, 1_000_000), (3, 300), (1, 1000)])
def test_equals_brute_force(spark, monkeypatch, group, letters):
    monkeypatch.setattr(sp, "GROUP", group)
    monkeypatch.setattr(sp, "TASK_LETTERS", letters)
    monkeypatch.setattr(sp, "STEP", 40)
    rows = check(spark, corpus(group))
    assert any(r[1] for r in rows) and any(r[4] > 3 for r in rows)


def test_chain_of_forms(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000}
    docs = [(k, " ".join([w] * (n // 2))) for k, (w, n) in enumerate((w, n) for w, n in words.items() for _ in range(2))]
    while any(zlib.crc32(f"{i}:{t.split(' ')[0]}".encode()) % 31 == 0 for i, t in docs):
        docs = [(i + 10, t) for i, t in docs]
    rows = {r[0]: r for r in check(spark, docs)}
    assert {r[2] for r in rows.values()} == {"abcdefghijk"} and rows["abcdefg"][1] == "abcdefgh"


def test_no_words(spark):
    assert check(spark, []) == [] and check(spark, [(1, None), (2, "short words"), (3, "singular")]) == []


def test_very_long_words(spark):
    check(spark, [(1, " ".join("x" * k + "y" for k in (5000, 5000, 5001, 5001)) + " " + " ".join(["z" * 5002] * 2))])


def test_pairs_come_once(spark, monkeypatch):
    monkeypatch.setattr(sp, "GROUP", 4)
    n = plain_words(corpus(9))
    got = [tuple(r) for r in sp.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in n for b in n if differ_by_one(a, b)}


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 64, 100):
        values = rng.permutation(size)
        tree = sp.WaveletTree(values)
        left, low = rng.integers(0, size + 1, (2, 50))
        right, high = np.minimum(left + rng.integers(0, size + 1, 50), size), low + rng.integers(0, size + 1, 50)
        which, value = tree.report(left, right, low, high)
        want = sorted((k, int(v)) for k in range(50) for v in values[left[k] : right[k]] if low[k] <= v < high[k])
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == want


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows = {tuple(r) for r in sp.variants(table(spark, sf, "documents")).collect()}
    n = plain_words(docs)
    assert {(r[0], r[3]) for r in rows} == set(n.items())
    some = sorted(n)[::50]
    assert {r[0]: r[4] for r in rows if r[0] in some} == {w: sum(differ_by_one(w, x) for x in n if abs(len(x) - len(w)) < 2) for w in some}
