import random

import numpy as np
import pytest

from alignspark.llm import substring as sub


def slow_windows(values, span):
    out = []
    for c in range(len(values)):
        l = c
        while l and values[l - 1] > values[c]:
            l -= 1
        r = c
        while r + 1 < len(values) and values[r + 1] > values[c]:
            r += 1
        if r - l + 1 >= span:
            out.append((c, l, r))
    return out


@pytest.mark.parametrize("span", [2, 5, 9])
def test_windows_are_the_wide_nodes_of_the_cartesian_tree(span):
    rng = np.random.default_rng(span)
    for _ in range(60):
        sizes = rng.integers(0, 40, size=4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        tokens = rng.integers(0, 10 if rng.random() < 0.3 else 2**63, size=int(first[-1]), dtype=np.uint64)
        seed = np.uint64(rng.integers(2**62))
        got = list(zip(*(x.tolist() for x in sub.compact_windows(tokens, first, seed, span)), strict=True))
        values = (sub.mix(tokens ^ seed) >> np.uint64(26) << np.uint64(26)) | np.arange(len(tokens), dtype=np.uint64)
        want = [(d, first[d] + c, first[d] + l, first[d] + r) for d in range(4) for c, l, r in slow_windows(values[first[d] : first[d + 1]].tolist(), span)]
        assert got == want


def test_windows_of_a_key_are_a_span_apart_at_least():
    rng = np.random.default_rng(4)
    for size in (0, 1, 30, 400):
        rows = np.unique(np.stack([rng.integers(0, 3, size), rng.integers(0, 4, size), rng.integers(0, 200, size)]), axis=1)
        own, key, centre = rows[0], rows[1].astype(np.uint64), rows[2]
        want, last = [], {}
        for k, (o, x, c) in enumerate(zip(own.tolist(), key.tolist(), centre.tolist(), strict=True)):
            if (o, x) not in last or c - last[o, x] >= 7:
                last[o, x] = c
                want.append(k)
        assert sub._apart(own, key, centre, 7).tolist() == want
    run = np.arange(1000)  # every place of a run: not its first window alone
    assert sub._apart(np.zeros(1000, int), np.ones(1000, np.uint64), run, 46).tolist() == run[::46].tolist()


def corpus():
    rng = random.Random(6)
    text = lambda n: [rng.choice("abcdefghijklmnopqrst") + str(rng.randint(0, 60)) for _ in range(n)]
    exact = [text(n) for n in (50, 52, 80, 300)]
    near = text(150)
    line, common = text(41), text(60)
    docs, planted = [], {}
    for i in range(140):
        w = text(rng.choice([0, 10, 60, 200]))
        k = i % 7
        if k == 0:
            p = rng.choice(exact)
        elif k == 1:
            p = list(near)
            for j in rng.sample(range(150), rng.choice([0, 1, 2])):
                p[j] = "zz"
            if rng.random() < 0.5:
                p.insert(70, "yy")
        elif k in (2, 3):
            p = common
        elif k == 4:
            p = line
        else:
            p = []
        at = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + p + w[at:])))
        if k < 4:
            planted[i] = (at, at + len(p), k)
    docs += [(900, None), (901, ""), (902, "x " * 400), (903, "x " * 20_000), (904, "solo " + " ".join(common[:49]) + " end")]
    return docs, planted


def runs(a, b):
    """Maximal equal runs of 50 words or more, as spans of a."""
    out, prev = [], {}
    where = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    for i, w in enumerate(a):
        cur = {j: prev.get(j - 1, 0) + 1 for j in where.get(w, ())}
        out += [(i + 1 - n, i + 1) for n in cur.values() if n >= 50]
        prev = cur
    return out


def test_passages(spark):
    docs, planted = corpus()
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in docs], "doc_id long, text string, other int, key string").repartition(3)
    got = {}
    for r in sub.repeated_passages(df).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert r.n_words >= 50 and r.other_doc != r.doc_id
    for i, (a, b, k) in planted.items():
        if k == 1:  # near copies: most of the passage, whatever words were changed at its ends
            assert sum(max(0, min(b, y) - max(a, x)) for x, y in got[i]) >= 0.8 * (b - a), i
        else:
            assert any(x <= a and b <= y for x, y in got[i]), (i, a, b, got.get(i))
    clean = {i for i, _ in docs} - set(planted) - {902, 903}
    assert not clean & set(got)
    split = {i: (t or "").lower().split() for i, t in docs if i < 60}
    for i in split:
        for j in split:
            if i != j:
                for a, b in runs(split[i], split[j]):
                    assert any(x <= a and b <= y for x, y in got[i])


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t.upper().replace(" ", ", "))], "doc_id long, text string")
    assert sorted(map(tuple, sub.repeated_passages(df).collect())) == [(1, 0, 60, 60, 2), (2, 0, 60, 60, 1)]
    assert sub.repeated_passages(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, t + " x " + t)], "doc_id long, text string")
    assert sub.repeated_passages(alone).count() == 0


def test_equal_passages_that_the_smallest_document_holds_in_part(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, planted = [], {}
    for g in range(80):
        p, part = text(50), rng.randint(28, 49)
        at = rng.randint(0, 50 - part)
        docs.append((3 * g, " ".join(text(40) + p[at : at + part] + text(40))))
        for i in (3 * g + 1, 3 * g + 2):
            docs.append((i, " ".join(text(60) + p + text(60))))
            planted[i] = 6 * g + 3 - i
    twice = text(50)
    docs += [(900, " ".join(twice + text(70) + twice)), (901, " ".join(text(9) + twice))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.start_word): (r.end_word, r.other_doc) for r in sub.repeated_passages(df).collect()}
    assert got == {(i, 60): (110, other) for i, other in planted.items()} | {(900, 0): (50, 901), (900, 120): (170, 901), (901, 9): (59, 900)}


def test_copies_have_one_whole_passage(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    whole, short, part = text(120), text(30), text(70)
    docs = [(5, whole), (3, whole), (9, whole), (9, whole), (6, short), (7, short), (2, text(20) + " " + " ".join(whole.split()[10:80]) + " " + text(5)), (11, part), (12, part + " more"), (13, None), (14, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sub.repeated_passages(df).collect()))
    assert got == [(2, 20, 90, 70, 3), (3, 0, 120, 120, 2), (5, 0, 120, 120, 2), (9, 0, 120, 120, 2), (11, 0, 70, 70, 12), (12, 0, 70, 70, 11)]


@pytest.mark.parametrize("n,changed", [(50, 1), (100, 2), (100, 1), (200, 4)])
def test_recall_of_changed_passages(spark, n, changed):
    """Passages with changed words, each in two documents of other words: at least nine in ten are found in both."""
    rng = random.Random(n + changed)
    text = lambda k: [f"w{rng.randrange(10**7)}" for _ in range(k)]
    docs = []
    for g in range(200):
        p = text(n)
        q = list(p)
        for at in rng.sample(range(5, n - 5), changed):
            q[at] = f"c{rng.randrange(10**7)}"
        docs += [(2 * g, " ".join(text(40) + p + text(40))), (2 * g + 1, " ".join(text(70) + q + text(20)))]
    got = {(r.doc_id, r.other_doc) for r in sub.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got <= {(i, i ^ 1) for i, _ in docs}
    assert sum((2 * g, 2 * g + 1) in got and (2 * g + 1, 2 * g) in got for g in range(200)) >= 180


def test_changed_passage_of_two_documents_under_outliers_of_smaller_ids(spark):
    """Each of twenty smaller documents holds one of the passage's equal stretches, all shorter than a passage."""
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    stretches = [text(45) for _ in range(4)]
    passage = lambda: [w for s in stretches for w in [*s, *text(1)]]
    outliers = [(i, " ".join(text(60) + stretches[i % 4] + text(60))) for i in range(20)]
    rows = [*outliers, (100, " ".join(text(70) + passage() + text(70))), (101, " ".join(text(90) + passage() + text(70)))]
    found = {r.doc_id: r for r in sub.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(found) == {100, 101}
    assert found[100].other_doc == 101 and found[101].other_doc == 100
    assert found[100].n_words >= 180 and found[100].start_word == 70 and found[101].start_word == 90


def test_windows_of_a_large_key_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    around = rng.integers(1, 60000, (40, 2 * sub.AROUND + 1)).astype(np.uint16)
    around[7] = around[31]
    around[12, :50], around[12, 60:] = around[20, :50], 0
    assert set(sub._crowd_pairs(np.arange(40), around)) == {(7, 31), (31, 7), (12, 20), (20, 12)}
    monkeypatch.setattr(sub, "LOOKED_AT", 5)
    assert set(sub._crowd_pairs(np.arange(40), around)) == {(7, 31), (31, 7), (12, 20), (20, 12)}
    monkeypatch.setattr(sub, "CROWD", 3)
    test_changed_passage_of_two_documents_under_outliers_of_smaller_ids(spark)


def test_windows_of_many_keys_take_steps_together(monkeypatch):
    """Four windows a key, two of them alike; what meets is as if each key were alone, in a few steps for all of them."""
    rng, keys = np.random.default_rng(6), 500
    around = rng.integers(1, 60000, (4 * keys, 2 * sub.AROUND + 1)).astype(np.uint16)
    around[2::4] = around[::4]
    around[2::4, :9] = 0
    doc, calls, plain = np.tile(np.arange(4), keys), [], sub._in_passages
    monkeypatch.setattr(sub, "_in_passages", lambda equal: calls.append(len(equal)) or plain(equal))
    alone = {(4 * k + i, 4 * k + j) for k in range(keys) for i, j in sub._crowd_pairs(doc[:4], around[4 * k : 4 * k + 4])}
    assert alone == {x for k in range(keys) for x in ((4 * k, 4 * k + 2), (4 * k + 2, 4 * k))}
    calls.clear()
    assert set(sub._crowd_pairs(doc, around, np.arange(0, 4 * keys + 1, 4))) == alone and len(calls) < 20
