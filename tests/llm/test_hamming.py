import random

import duckdb
import pytest

from alignspark.llm import hamming
from alignspark.llm.common import table


def plain(rows, asked, k):
    code = {i: sum(1 << j for j, x in enumerate(v) if x is not None and x > 0) for i, v in rows}
    out = []
    for q in asked:
        near = sorted(((code[q] ^ c).bit_count(), i) for i, c in code.items() if i != q)[:k]
        out += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("bits,n,k", [(16, 300, 5), (64, 200, 10), (12, 40, 60), (7, 30, 3)])
def test_equals_brute_force(spark, bits, n, k):
    rng = random.Random(bits)
    base = [[rng.gauss(0, 1) for _ in range(bits)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = list(rng.choice(base)) if i % 3 else list(base[0])
        for _ in range(rng.choice([0, 0, 1, 3, bits])):
            v[rng.randrange(bits)] = rng.choice([rng.gauss(0, 1), 0.0, None])
        rows.append((i, v))
    data = rows + [(n + 1, None), (n + 2, [1.0] * (bits + 1)), (n + 3, [])]
    df = spark.createDataFrame([(i, v, i) for i, v in data], "vec_id long, embedding array<float>, code long")
    got = hamming.top_k(df, df.where("vec_id % 10 = 0"), k, bits).collect()
    assert sorted(map(tuple, got)) == plain(rows, [i for i, _ in rows if i % 10 == 0], k)


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (1, [1.0, float("nan")]), (2, [1.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, hamming.top_k(df, df, 3, 2).collect())) == [(1, 2, 0, 1), (2, 1, 0, 1)]
    assert hamming.top_k(df.limit(0), df.limit(0), 3, 2).count() == 0


def test_sql(spark, sf):
    df = table(spark, sf, "embeddings")
    got = sorted(map(tuple, hamming.top_k(df, df.where("vec_id % 100 = 0"), 10, 64).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(hamming.ORACLE).fetchall())
