import random
import re

from alignspark.llm import pii

# The contract's patterns as written.
BASE = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {0: True, 1: k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 2: 12 <= len(d) <= 19 and pii.luhn(d), 3: 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "_d@e.f", "x.y@", "@", "1.2.3.4", ".5.6", "300.1.1.1", "4111 1111 1111 1111", "-", " ", "+1 (017) 555-7713", "+", "9" * 13, "é", "b-c.d", "é9", "0", "(", "001.002.03.4", "..", "١٢٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_checksums_and_added_spans():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    base, every = pii.find_spans("IBAN DE89 3704 0044 0532 0130 00 please")
    assert ("iban" in pii.listed(every)) and [s for s in base if s not in every] == []
    base, every = pii.find_spans("credit card 4111 1111 1111 1111 12 today")
    assert base == [] and pii.listed(every) == "card:12:31"
    assert pii.find_spans("order 4111 1111 1111 1111 12 today")[1] == []
    assert pii.redact_text("mail a@b.co or +1 (017) 555-7713.") == "mail [EMAIL] or [PHONE]."


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "1 " * 150_000, "a@" * 100_000, "A1" * 100_000):
        pii.find_spans(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "x a@b.co", 7), (3, "x a@b.co", 7)], "doc_id long, text string, spans int")
    rows = sorted(pii.detect(df).collect(), key=lambda r: r.doc_id)
    assert [r.n_email for r in rows] == [0, 0, 1, 1] and rows[2].spans == "email:2:8" and rows[0].spans == ""
    assert rows[2].scored[0]["score"] > 0.8
    assert pii.detect(df.limit(0)).count() == 0
    out = df.select(pii.redacted(df.text).alias("t")).collect()
    assert [r.t for r in out] == [None, "", "x [EMAIL]", "x [EMAIL]"]


def test_ibans_end_where_the_checksum_confirms_them():
    german, british, unlisted = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "XX"
    for check in range(2, 99):
        if pii.mod97(f"XX{check:02}ABCDEFGH345678K"):
            unlisted = f"XX{check:02} ABCD EFGH 3456 78K"
    found = lambda t: [t[s:e] for s, k, e in pii.find_spans(t)[1] if k == 4]
    for iban in (german, british, unlisted, german.replace(" ", "")):
        for after in ("", " BIC COBADEFFXXX", " 2024", " 1250 EUR", " A", ". AB", " " + "9" * 40):
            assert found(f"IBAN {iban}{after}") == [iban], (iban, after)
    assert found(f"accounts {german} {british} {german}") == [german, british, german]
    assert found(f"bank AB12 {german}") == [german]
    assert found(f"IBAN {german[:-1]}1 BIC COBADEFFXXX") == [] and found(f"IBAN {german}9") == [] and found(f"IBAN {german}x") == []
    assert pii.redact_text(f"IBAN {german} BIC COBADEFFXXX") == "IBAN [IBAN] BIC COBADEFFXXX"
