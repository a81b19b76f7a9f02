import random

from alignspark.llm import tokens


def texts(n=300):
    rng = random.Random(1)
    alphabet = " ab the é\n\t　x１中▁<s>' \xa0."
    return ["", " ", "  ", "a ", " a", "a  "] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["word " * 30_000, "x" * 5_000]


def test_counts_equal_the_library(spark):
    data = [*texts(2000), None]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(data)], "doc_id long, text string, n_tokens int")
    sp = tokens._processor(tokens.model_path())
    got = {r.doc_id: r for r in tokens.token_counts(df, limit=20, tables=True).collect()}
    for i, t in enumerate(data):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 20), t
        fits = max((i for i in range(min(len(t or ""), 120) + 1) if len(sp.encode(t[:i])) <= 20), default=0) if n > 20 else len(t or "")
        assert got[i].fits_chars == fits, t
        for b, c in list(zip(got[i].prefix_bytes, got[i].prefix_tokens, strict=True))[:30]:
            assert len(sp.encode(t.encode()[:b].decode())) == c
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_every_character_prefix():
    sp, prefix = tokens._processor(tokens.model_path()), tokens.PiecePrefix()
    for t in texts():
        t = t[:300]
        index = tokens.PrefixIndex(t, prefix)
        assert index.at == [len(sp.encode(t[:i])) for i in range(len(t) + 1)], t


def test_truncation(spark):
    data = [*texts(60), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "doc_id long, text string")
    sp = tokens._processor(tokens.model_path())
    for r in tokens.truncate_to_budget(df, 12).collect():
        whole = data[r.doc_id]
        if not whole or len(sp.encode(whole)) <= 12:
            assert r.text == whole
        else:
            assert r.text == whole[: max(i for i in range(min(len(whole), 200) + 1) if len(sp.encode(whole[:i])) <= 12)]
