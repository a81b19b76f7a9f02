import random
from collections import Counter, defaultdict

from alignspark.llm import packing, tokens


def test_each_piece_gets_the_tightest_compatible_bin():
    rng = random.Random(2)
    for _ in range(60):
        pieces = sorted(((rng.randint(1, 50), rng.choice([0, 0, 1, 2]), rng.choice([None, 1, 1, 2, 3])) for _ in range(80)), key=lambda x: -x[0])
        room, held = [], []
        for (size, source, cluster), b in zip(pieces, packing.pack_shard(pieces, 50, 2), strict=True):
            fits = [k for k in range(len(room)) if room[k] >= size and sum(s == source for s, _ in held[k]) < 2 and (cluster is None or all(c != cluster for _, c in held[k]))]
            if fits:
                assert b in fits and room[b] == min(room[k] for k in fits)
            else:
                assert b == len(room)
                room.append(50)
                held.append([])
            room[b] -= size
            held[b].append((source, cluster))


def rows(spark, n=300):
    rng = random.Random(8)
    out = []
    for i in range(n):
        t = rng.choice([None, "", "a b c", "same text here", "Same  text here"] + ["word " * rng.randint(1, 4000)] * 12)
        out.append((i, t, rng.choice(["hot", "hot", "x", "y", None]), 5, "bin"))
    return out, spark.createDataFrame(out, "doc_id long, text string, source string, n_tokens int, bin_id string")


def test_bins(spark):
    data, df = rows(spark)
    got = packing.best_fit(df, capacity=1000, max_per_source=2, shard=100).collect()
    sp = tokens._processor(tokens.model_path())
    by_doc, bins = defaultdict(list), defaultdict(list)
    text = {r[0]: (r[1], r[2]) for r in data}
    for r in got:
        by_doc[r.doc_id].append(r)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for i, (t, _) in text.items():
        n = len(sp.encode(t or ""))
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in parts) == n and (n > 0 or parts[0].bin_id is None)
        at = 0
        for r in parts:
            assert r.first_token == at
            at += r.n_tokens
    for held in bins.values():
        held.sort(key=lambda r: r.place)
        at = 0
        for r in held:
            assert r.place == at
            at += r.n_tokens
        assert at <= 1000
        assert max(Counter(text[r.doc_id][1] for r in held).values()) <= 2
        plain = Counter(" ".join((text[r.doc_id][0] or "").lower().split()) for r in held)
        assert max(plain.values()) == 1


def test_edges(spark):
    _, df = rows(spark, 5)
    assert packing.best_fit(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    got = packing.best_fit(twice).collect()
    assert len(got) == 3 and len({r.bin_id for r in got if r.doc_id == 1}) == 2
