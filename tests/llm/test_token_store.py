import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from alignspark.llm import token_store as ts
from alignspark.llm.common import new_path


def rows(n=120):
    rng = random.Random(5)
    bits = [" the", " cat", "é", " été", "\n", "  ", "　", " <|endoftext|>x", "<|endoftext|>", "'s", " 12", "!!", "\t", " ▁", " a\xa0b", "中 文"]
    out = [(7 * i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 80, 3000])))) for i in range(n)]
    return out + [(900_001, None), (900_002, ""), (900_003, out[5][1]), (900_004, out[5][1]), (900_005, " ")]


def plain(text):
    return [*ts._tokenizer(ts.model_path()).encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_give_the_library_ids():
    data = rows(400)
    ids, ends = ts.encode(ts.model_path(), pa.array([t for _, t in data]), 0)
    at = 0
    for (_, t), end in zip(data, ends, strict=True):
        assert ids[at:end].tolist() == plain(t)
        at = end


def test_crc_parts_add_up():
    a, b, c = b"hello", b"", b"world" * 100
    parts = ts.crc_shift(np.array([zlib.crc32(x) for x in (a, b, c)]), np.array([len(b + c), len(c), 0]))
    assert int(np.bitwise_xor.reduce(parts)) == zlib.crc32(a + b + c)


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, hash int").repartition(5)
    path = new_path(spark, "store")
    ts.write_store(df, path)
    got = {r.doc_id: r for r in ts.read_store(spark, path).collect()}
    assert len(got) == len(data)
    start = 0
    for i, t in sorted(data):
        ids = plain(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = {r.doc_id: r.ids for r in ts.read_documents(spark, path, df).collect()}
    assert all(back[i] == plain(t) for i, t in data)
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.where("payload is not null").count() == stored.select("hash").distinct().count()


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    path = new_path(spark, "store")
    ts.write_store(df, path)
    spark.read.parquet(f"{path}/recipes").selectExpr("doc_id", "n_tokens", "upper(root) || 'x' as root", "part").write.parquet(f"{path}/bad")
    import shutil

    local = path.removeprefix("file://")
    shutil.rmtree(f"{local}/recipes")
    shutil.move(f"{local}/bad", f"{local}/recipes")
    with pytest.raises(Exception, match="does not match its recipe"):
        ts.read_store(spark, path).collect()


def test_empty_table(spark):
    path = new_path(spark, "store")
    ts.write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert ts.read_store(spark, path).count() == 0


def test_repeated_ids_are_stored_one_by_one(spark):
    long = "the cat sat on a mat " * 900
    data = [(1, long), (1, long), (1, "other"), (2, "a b"), (2, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    path = new_path(spark, "store")
    ts.write_store(df, path)
    got = sorted(ts.read_store(spark, path).collect(), key=lambda r: r.start)
    crc = lambda t: (len(plain(t)), zlib.crc32(np.array(plain(t), "<u4").tobytes()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, *crc(t)) for i, t in data)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.ids) for r in ts.read_documents(spark, path, df).collect()) == sorted((i, plain(t)) for i, t in data)


def rewritten(spark, path, name, change):
    """The store with one of its tables changed."""
    import shutil

    change(spark.read.parquet(f"{path}/{name}")).write.parquet(f"{path}/new")
    local = path.removeprefix("file://")
    shutil.rmtree(f"{local}/{name}")
    shutil.move(f"{local}/new", f"{local}/{name}")


@pytest.mark.parametrize("name, change, says", [
    ("manifest", lambda d: d.selectExpr("part", "documents", "n_ids", "first_doc", "sha2(roots, 256) as roots"), "does not match the store's root"),
    ("manifest", lambda d: d.selectExpr("part", "documents + 1 as documents", "n_ids", "first_doc", "roots"), "does not match the store's root"),
    ("manifest", lambda d: d.limit(0), "does not match the store's root"),
    ("root", lambda d: d.limit(0), "does not match the store's root"),
    ("root", lambda d: d.selectExpr("sha2(root, 256) as root", "width"), "does not match the store's root"),
    ("recipes", lambda d: d.selectExpr("3 - doc_id as doc_id", "n_tokens", "root", "part"), "does not match"),
    ("recipes", lambda d: d.where("doc_id > 1"), "does not match its recipe"),
    ("chunks", lambda d: d.where("uses[0].doc > 1"), "does not match its recipe"),
])
def test_every_level_is_compared(spark, name, change, says):
    path = new_path(spark, "store")
    ts.write_store(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string"), path, partitions=1)
    rewritten(spark, path, name, change)
    with pytest.raises(Exception, match=says):
        ts.read_store(spark, path).collect()


def test_a_partition_lost_with_its_documents_is_found(spark):
    path = new_path(spark, "store")
    ts.write_store(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string"), path)
    rewritten(spark, path, "recipes", lambda d: d.where("doc_id > 1"))
    rewritten(spark, path, "chunks", lambda d: d.where("uses[0].doc > 1"))
    with pytest.raises(Exception, match="manifest"):
        ts.read_store(spark, path).collect()


def test_damage_below_a_sound_root_is_found(spark):
    """A partition's root is wrong and the top one was made to fit."""
    path = new_path(spark, "store")
    ts.write_store(spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string"), path, partitions=3)
    rewritten(spark, path, "manifest", lambda d: d.selectExpr("part", "documents", "n_ids", "first_doc", "if(part = 1, sha2(roots, 256), roots) as roots"))
    rewritten(spark, path, "root", lambda d: ts._top(spark.read.parquet(f"{path}/manifest")).selectExpr("root", "2 as width"))
    with pytest.raises(Exception, match="do not match the manifest, partition 1"):
        ts.read_store(spark, path).collect()
    swapped = new_path(spark, "store")
    ts.write_store(spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string"), swapped, partitions=3)
    rewritten(spark, swapped, "manifest", lambda d: d.selectExpr("case part when 0 then 1 when 1 then 0 else part end as part", "documents", "n_ids", "first_doc", "roots"))
    with pytest.raises(Exception, match="does not match the store's root"):
        ts.read_store(spark, swapped).collect()


def test_a_third_of_empty_texts(spark, monkeypatch):
    """The rows of the chunk that all of them share are dealt out; one keeps the payload, and the store reads back."""
    monkeypatch.setattr(ts, "CUT_BYTES", 40)
    monkeypatch.setattr(ts, "BLOCK", 7)
    data = [(k, "" if k % 3 else f"some text {k}") for k in range(300)]
    path = new_path(spark, "store")
    ts.write_store(spark.createDataFrame(data, "doc_id long, text string").repartition(5), path, partitions=4)
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.where("payload is not null").count() == stored.select("hash").distinct().count() == 101
    got = {r.doc_id: r for r in ts.read_store(spark, path).collect()}
    at = 0
    for i, t in data:
        assert (got[i].start, got[i].n_tokens) == (at, len(plain(t)))
        at += len(plain(t))
