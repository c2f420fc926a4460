"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four kinds are always reported when their pattern and check agree (email, ip, card, phone).
The others (iban, ssn, tel) need their checksum or number rules, and score above the threshold
only with a confirmed checksum or a fitting word nearby. Every pattern is walked from left to
right in time linear in the text, whatever the text is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of kinds for spans that start at the same place.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: Code points before and after a span in which a context word counts.
NEARBY = 40
#: What pattern and check are worth alone; a context word adds ``CONTEXT``.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "tel": 0.3}
CONTEXT = 0.3
WORDS = {
    "email": r"e-?mail|contact|mail|correo|courriel",
    "ip": r"ip|host|server|address|client",
    "card": r"card|visa|credit|debit|karte|tarjeta|carte|payment",
    "phone": r"phone|tel|call|mobile|fax|telefon|tel[eé]fono",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "ssn": r"ssn|social security|tax id|taxpayer",
    "tel": r"phone|tel|call|mobile|fax|telefon|tel[eé]fono",
}
_NEAR = {k: re.compile(rf"\b(?:{w})\b", re.I) for k, w in WORDS.items()}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits fails as a whole or not at all, so only its first digit is tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
SPAN = "array<struct<kind: string, start: int, stop: int, score: double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        # capitals after the number may have been taken along: give up group after group
        value = m.group()
        while True:
            plain = value.replace(" ", "")
            if len(plain) < 15:
                break
            if mod97(plain):
                yield m.start(), m.start() + len(value)
                break
            cut = value.rfind(" ")
            if cut < 0:
                break
            value = value[:cut]


def _proposed(text: str):
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for s, e in _ibans(text):
        yield "iban", s, e
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()
    for m in _TEL.finditer(text):
        yield "tel", m.start(), m.end()


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """Confirmed spans (kind, start, end, score), by start, then kind as listed."""
    if not text:
        return []
    out, taken = [], []
    for kind, s, e in _proposed(text):
        if kind == "tel" and any(a < e and s < b for a, b in taken):
            continue
        around = f"{text[max(0, s - NEARBY):s]} {text[e:e + NEARBY]}"
        score = min(1.0, SCORES[kind] + CONTEXT * bool(_NEAR[kind].search(around)))
        if score >= THRESHOLD:
            out.append((kind, s, e, round(score, 3)))
            if kind in ("card", "phone", "ip", "iban", "ssn"):
                taken.append((s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_spans(text: Column) -> Column:
    """array of (kind, start, stop, score) in code points, stop exclusive; NULL and '' give none."""

    @F.pandas_udf(SPAN)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "stop": e, "score": p} for k, s, e, p in spans_of(t)] for t in texts])

    return find(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans by the first one's.

    Texts without a span, NULL and empty ones included, stay exactly as they are, and so do all
    other columns, repeated rows and the order of columns.
    """

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        def one(text):
            out, at, free = [], 0, 0
            for kind, s, e, _ in spans_of(text):
                if s >= free:
                    out += [text[at:s], f"[{kind.upper()}]"]
                free = at = max(free, e)
            return "".join([*out, text[at:]]) if out else text
        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, hide(F.col(text_col)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
