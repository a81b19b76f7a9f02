"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping within a kind.  Long runs of digits or letters cost time in
proportion to their length: a pattern is only tried where a match can start.
Two more kinds are added, never replacing base spans: ``iban`` (its end is where
mod-97 confirms it, whatever follows in capitals or digits after a space) and
``card`` numbers that sit inside a longer run of digit groups, taken only if
Luhn confirms them and a word that announces a card stands nearby.

Every span has a score: the kind's prior, raised by a confirmed checksum and
by announcing words within ``CONTEXT`` characters, lowered by words that
announce other numbers.  Base spans are always reported; added ones from 0.5.

Defined results: null and empty texts have no spans; offsets count code
points, ends are exclusive; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
N_BASE = 4
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_WORD = re.compile(r"[A-Za-z0-9]")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
#: Countries by the length of their IBANs.
_IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH BY CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_SIZE = {country: size for size, countries in _IBAN_SIZES.items() for country in countries.split()}
_ANNOUNCE = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|addr(?:ess)?|host|server)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cc)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|transfer)\b"),
}
_DENY = re.compile(r"(?i)\b(?:version|invoice|order|isbn|serial|tracking)\b")
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.6}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an IBAN without spaces has the right check digits."""
    return int("".join(str(int(ch, 36)) for ch in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            cursor = found.end()
        at = text.find("@", max(at + 1, cursor))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        parts, start = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and (not x or int(x) <= 255) for p in four):
                yield start, end
            start = end + 1


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(s, 1, e) for s, e in _ips(text)]
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return sorted(out)


def score(text: str, start: int, kind: int, end: int, checked: bool) -> float:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT // 2]
    s = _PRIOR[KINDS[kind]] + 0.2 * checked + 0.2 * bool(_ANNOUNCE[KINDS[kind]].search(near)) - 0.3 * bool(_DENY.search(near))
    return min(max(s, 0.0), 1.0)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that mod-97 confirms: of the country's length, else up to the end of a group, the longest first."""
    at = 0
    while head := _IBAN.search(text, at):
        start, at = head.start(), head.end()
        rest = _IBAN_REST.match(text, at)
        if not rest:
            continue
        places = [i for i in range(start, rest.end()) if text[i] != " "]
        sizes = [n for n in range(len(places), 14, -1) if not (places[n - 1] + 1 < len(text) and _WORD.match(text[places[n - 1] + 1]))]
        sizes.sort(key=lambda n: n != _IBAN_SIZE.get(head.group()[:2]))
        code = "".join(text[i] for i in places)
        found = next((n for n in sizes if mod97(code[:n])), 0)
        if found:
            at = places[found - 1] + 1
            yield start, at


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    taken = [(s, e) for s, _, e in base]
    free = lambda s, e: all(e <= a or b <= s for a, b in taken)
    out = []
    for s, e in _ibans(text):
        if free(s, e) and score(text, s, 4, e, True) >= 0.5:
            out.append((s, 4, e))
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() < 17 or not _ANNOUNCE["card"].search(text[max(0, m.start() - CONTEXT) : m.start()]):
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer(r"[0-9]+", m.group())]
        i = 0
        while i < len(groups):
            hit = 0
            for j in range(i, min(i + 5, len(groups))):
                s, e = groups[i][0], groups[j][1]
                d = _digits(text[s:e]) if e - s <= 23 else ""
                if 15 <= len(d) <= 16 and d[0] in "3456" and luhn(d) and free(s, e) and score(text, s, 2, e, True) >= 0.5:
                    out.append((s, 2, e))
                    hit = j + 1
                    break
            i = hit or i + 1
    return out


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted by start and then kind."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _proposals(texts: pa.Array):
    """Texts that hold a digit or an at sign; the others can have no span."""
    return pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_numpy(zero_copy_only=False)


def detect(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, the digest of base spans, all spans as text and with scores.  One Arrow pass."""
    src = documents.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts, n = batch.column(1), len(batch)
            counts = [[0] * n for _ in range(N_BASE)]
            digest, spans, scored = [nothing] * n, [""] * n, [[] for _ in range(n)]
            for i in _proposals(texts).nonzero()[0]:
                text = texts[int(i)].as_py()
                base, every = find_spans(text)
                for _, k, _ in base:
                    counts[k][i] += 1
                if base:
                    digest[i] = hashlib.sha256(listed(base).encode()).hexdigest()
                spans[i] = listed(every)
                scored[i] = [{"kind": KINDS[k], "start": s, "end": e, "score": score(text, s, k, e, k in (2, 4))} for s, k, e in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(scored, scored_type)], names=names)

    scored_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scored array<struct<kind:string,start:int,end:int,score:double>>")


def redact_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become the first of them."""
    out, at = [], 0
    for s, k, e in find_spans(text)[1]:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    """A text column without personal data; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        some = _proposals(texts)
        if not some.any():
            return texts
        at = pa.array(some)
        return pc.replace_with_mask(texts, at, pa.array([redact_text(t) for t in texts.filter(at).to_pylist()], texts.type))

    return run(text)
