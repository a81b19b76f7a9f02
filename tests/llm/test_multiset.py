import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from alignspark.llm import multiset as ms
from alignspark.llm.common import table

DOCS = "doc_id long, text string, place int, range string, tail string"


def plain_lanes(text):
    """Both parts of a text's fingerprint, paragraph by paragraph."""
    exact, like = [0] * 8, [0] * 128
    for p in text.split("\n"):
        for seed in range(4):
            s = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
            h = xxhash.xxh64_intdigest(p.encode(), s)
            exact[2 * seed] += h & 0xFFFFFFFF
            exact[2 * seed + 1] += h >> 32
        before = None
        for w in p.replace("\r", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
            if w:
                h = xxhash.xxh64_intdigest(w.encode(), 42 if before is None else xxhash.xxh64_intdigest(before.encode(), 42))
                second = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
                for at, x in ((0, h), (64, second)):
                    for j in range(32):
                        for half in (0, 1):
                            like[at + 2 * j + half] += 1 if x >> (j + 32 * half) & 1 else -1
                before = w
    return [x % 2**32 for x in exact], [(x + 2**23) % 2**24 - 2**23 for x in like]


def plain_fingerprint(text):
    exact, like = plain_lanes(text)
    return "".join(f"{x:08x}" for x in exact) + "".join(f"{x % 2**24:06x}" for x in like)


def plain_likeness(a, b):
    (ea, la), (eb, lb) = plain_lanes(a), plain_lanes(b)
    if (ea, la) == (eb, lb):
        return 1.0
    size = sum(x * x for x in la) + sum(x * x for x in lb)
    return min(max(2 * sum(x * y for x, y in zip(la, lb, strict=True)) / size, 0.0), 1.0) if size else 0.0


def plain(docs):
    out = []
    twin = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, twin(r[1])))
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_fingerprint(t), plain_fingerprint(e), round(plain_likeness(t, e), 9), round(plain_likeness(t, after), 9)))
    return out


def check(spark, docs, parts=3):
    d = spark.createDataFrame([(i, t, 5, "r", "t") for i, t in docs], DOCS).repartition(parts)
    got = ms.edit_report(d)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()), key=key) == sorted(plain(docs), key=key)


@pytest.mark.parametrize("size", [1000, 7, 1])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ms, "RANGE", size)
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcé中😀") for _ in range(rng.choice([1, 2, 5])))
    docs = [(3 * i - 20, rng.choice(["\n", " ", "\n\n"]).join(" ".join(word() for _ in range(rng.choice([0, 1, 3, 8]))) for _ in range(rng.choice([1, 2, 5])))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, " \t\r\x0b\x0c "), (203, "again " * 3000), (204, "x" * 5000), (None, "no id"), (None, None), (7, "same"), (7, "same"), (7, "same id")]
    check(spark, docs)


@pytest.mark.parametrize("docs", [[], [(5, "alone with itself")], [(5, None)], [(1, "a b c d"), (2, "e f g h")], [(9, "alike")] * 5])
def test_few_documents(spark, monkeypatch, docs):
    monkeypatch.setattr(ms, "RANGE", 2)
    check(spark, docs, 2)


def test_insertion_and_deletion(spark):
    df = spark.createDataFrame([("one two\nthree\nfour five six\nthree", "three\none two", "four five six\nthree", "three\nthree\nfour five six\none two", "")], "whole string, a string, b string, shuffled string, none string")
    for c in df.columns:
        prints = ms.fingerprints(df, c).withColumnRenamed("fingerprint", f"p_{c}")
        df = df.crossJoin(prints)
    r = df.select(
        ms.inserted(F.col("p_a"), F.col("p_b")).alias("ab"), ms.inserted(F.col("p_b"), F.col("p_a")).alias("ba"), ms.deleted(F.col("p_whole"), F.col("p_a")).alias("rest"),
        ms.likeness(F.col("p_whole"), F.col("p_shuffled")).alias("same"), ms.likeness(F.col("p_a"), F.col("p_none")).alias("none"), *(f"p_{c}" for c in ("whole", "b", "shuffled")),
    ).first()
    assert r.ab == r.ba == r.p_whole == r.p_shuffled and r.rest == r.p_b and r.same == 1.0 and r.none == 0.0


def test_several_texts_of_one_key(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "c"), (2, "b\nc\na")], "k int, t string")
    got = {r.k: r.fingerprint for r in ms.fingerprints(df, "t").select(F.lit(0).alias("k"), "fingerprint").collect()}
    assert len(got) == 1


def test_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = ms.edit_report(docs).collect()
    near = sorted(r.near_edited for r in rows)
    assert len(rows) == docs.count() and near[len(near) // 20] > 0.4 and sum(r.near_next < r.near_edited for r in rows) >= 0.99 * len(rows)
    some = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.fingerprint == plain_fingerprint(some[r.doc_id]) for r in rows[:40])
    assert not any("Python" in x or "Pandas" in x or "Arrow" in x for x in ms.edit_report(docs)._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_one_shuffle_of_texts(spark, sf):
    """Bounds aside, texts are dealt out once; sums and windows stay where they lie."""
    plan = ms.edit_report(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(range") == 1 and plan.count("Exchange") == 1
