"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Four base kinds (email, ip, card, phone) are reported whenever their pattern and
their check agree. Two further kinds are reported only with enough evidence: an
account number (iban) whose mod-97 checksum holds, and a social security number
(ssn), which has no checksum and therefore needs a context word nearby.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# Patterns of the base kinds, fixed values. An address has its local part found
# from the at sign backwards, so only what follows it is a pattern here.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
# Countries that are not in the table: as far as capitals and digits go.
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Characters of an account number by country, fixed values of the public registry.
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")

# Score of a confirmed span without context, and the words that raise it.
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security)\b", re.I),
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
LEAST_SCORE = 0.5

SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Account numbers: four characters to the back, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the local part ends at an at sign and starts as early as it can."""
    free, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield start, domain.end()
        # No at sign is in a local part or a domain, so none is passed over.
        free = domain.end() if domain else sign + 1
        sign = text.find("@", free)


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: as many characters as the country has, single blanks between them not counted.

    What follows a whole number is not part of it, so a word in capitals may stand behind one.
    """
    free = 0
    for head in IBAN_HEAD.finditer(text):
        start = head.start()
        if start < free:
            continue
        size = IBAN_CHARS.get(text[start : start + 2])
        if size is None:
            whole = IBAN.match(text, start)
        else:
            whole = re.compile(rf"[A-Z0-9](?:\x20?[A-Z0-9]){{{size - 1}}}(?![A-Za-z0-9])").match(text, start)
        if whole and mod97(whole.group().replace(" ", "")):
            free = whole.end()
            yield start, free


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass the check of their kind, by kind and then by start."""
    for start, end in emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        # Parts of any length: leading zeros do not count.
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()
    for start, end in accounts(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def scored(text: str, least: float) -> list[dict]:
    found = []
    for kind, start, end in proposals(text):
        near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        score = min(1.0, SCORES[kind] + (CONTEXT_GAIN if CONTEXT[kind].search(near) else 0.0))
        if kind in BASE_KINDS or score >= least:
            found.append({"kind": kind, "start": start, "end": end, "score": score})
    return found


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``.

    Spans are in code points of the whole text, end exclusive, by kind (in the
    order of ``KINDS``) and start. Spans of one kind never overlap; spans of
    different kinds may. Base kinds stay at any score, further kinds from
    ``least`` up. A null or empty text has no spans; repeated rows and null ids
    give one row each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    value = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [scored(t.as_py() or "", least) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, value)], ["doc_id", "spans"])

    return rows.mapInArrow(search, f"doc_id bigint, spans {SPANS}")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, per row of :func:`find_pii`."""

    def shown(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[number(kind) for kind in BASE_KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
