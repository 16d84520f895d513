"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

Base kinds follow fixed rules (see ``KINDS``); ``iban`` is added by this method where its mod-97 sum holds at the length
of its country.
Each span gets a score: a start value per kind, more if a checksum confirmed it, more if one of the kind's
context words stands within ``CONTEXT_CHARS`` characters before or after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of the base kinds; iban is this method's addition.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
CONTEXT_CHARS = 40
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "bank", "account"),
}
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4}

# A run of digits either matches from its start or from nowhere in it, so a match need only be tried there:
# possessive runs keep this linear on texts of any length.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){0,20}")
#: Fixed number of characters of an IBAN by country; codes not listed may have 15 to 34.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards: the part before it is the whole run of allowed characters."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # what stands before this sign cannot belong to a later match
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost IBANs whose mod-97 sum holds: what follows may look like more of one, so every end that is not inside a run
    is tried, the longest first, of which a listed country allows one. The search goes on behind an IBAN, or else behind
    the start that gave none."""
    found = _IBAN.search(text)
    while found:
        start = found.start()
        run = text[start : _IBAN_REST.match(text, found.end()).end()]
        ends = [i for i, c in enumerate(f"{run[1:]} ", 1) if c == " "]
        if text[start + len(run) : start + len(run) + 1] in _RUN:  # cut at 34 characters
            ends.pop()
        only, floor = IBAN_LENGTHS.get(run[:2]), start + 1
        for end in reversed(ends):
            iban = run[:end].replace(" ", "")
            if (len(iban) == only if only else len(iban) >= 15) and mod97(iban):
                yield start, start + end
                floor = start + end
                break
        found = _IBAN.search(text, floor)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans by kind, then start; offsets in code points."""
    if not text:
        return []
    spans: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        spans += (("email", a, b, False) for a, b in emails(text))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", m.start(), m.end(), True))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end(), True))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end(), False))
        spans += (("iban", a, b, True) for a, b in ibans(text))
    return [(kind, a, b, _score(text, kind, a, b, confirmed)) for kind, a, b, confirmed in spans]


def _score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
    words = set(re.findall(r"[a-z]+", near))
    return round(min(1.0, START_SCORE[kind] + 0.2 * confirmed + 0.2 * any(w in words for w in CONTEXT_WORDS[kind])), 2)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its spans as (kind, start, end, score, value), by kind as listed and then start.

    A null text is read as empty and has no spans; a null id is kept. Whole texts are scanned, in time linear in their
    length. Repeated rows are each scanned. Extra columns are not looked at. An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                [(kind, a, b, score, text[a:b]) for kind, a, b, score in find(text)]
                for text in batch["text"]
            ]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": found})

    # ids go as text: pandas would round long ones beside a null
    schema = "doc_id string, spans array<struct<kind: string, start: int, end: int, score: double, value: string>>"
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of ``scan`` per document."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform(spans, lambda s: F.format_string("%.2f", s["score"])), ",")
    return scan(docs).select(
        "doc_id", *map(_count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), scores.alias("scores")
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
