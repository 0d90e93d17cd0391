"""Personal data in whole texts: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import add_columns, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that raise or lower a span's score when they stand within REACH code points of it.
NEAR: dict[str, tuple[re.Pattern, re.Pattern]] = {
    k: (re.compile(rf"\b(?:{up})\b", re.I), re.compile(rf"\b(?:{down})\b", re.I))
    for k, up, down in (
        ("email", "e-?mail|contact|write|reach|mailto", "example|noreply|test"),
        ("ip", "ip|host|server|client|address|login", "version|release|chapter|section"),
        ("card", "card|visa|mastercard|amex|credit|debit|cvv|expiry|expires", "isbn|order|invoice|serial|tracking"),
        ("phone", "phone|tel|call|mobile|cell|fax|whatsapp|sms", "score|result|ratio"),
        ("iban", "iban|bank|account|transfer|bic|swift", "serial|part|model"),
        ("ssn", "ssn|social|security|taxpayer|tax", "part|serial|model|order"),
    )
}
REACH = 48
#: Score of a span before context; kinds without a checksum of their own start lower.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
#: Least score of a kind outside BASE to be reported.
REPORT = 0.5


def octet(part: str) -> bool:
    """At most 255, with any number of leading zeros."""
    digits = part.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Accounts that mod-97 confirms; of a match in groups the longest confirmed run of them, as words may follow."""
    out = []
    m = IBAN.search(text)
    while m:
        end, at = m.end(), m.end()
        while end > m.start():
            a = text[m.start() : end].replace(" ", "")
            if 15 <= len(a) <= 34 and mod97(a):
                out.append((m.start(), end))
                at = end
                break
            end = text.rfind(" ", m.start(), end)
        else:
            at = text.find(" ", m.start(), m.end())
            at = m.end() if at < 0 else at
        m = IBAN.search(text, at)
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain.domain; each @ is tried once, its local part found from the right."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        part = text[free:at]
        start = free + len(part.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) by kind as in KINDS, then start."""
    out: list[tuple[str, int, int, float]] = []

    def add(kind: str, start: int, end: int) -> None:
        around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
        up, down = NEAR[kind]
        score = PRIOR[kind] + 0.3 * bool(up.search(around)) - 0.3 * bool(down.search(around))
        if kind in BASE or score >= REPORT:
            out.append((kind, start, end, min(1.0, max(0.0, score))))

    if "@" in text:
        for a, b in emails(text):
            add("email", a, b)
    for m in IP.finditer(text):
        if all(octet(p) for p in (m[0].partition(".")[0], m[1], m[2], m[3])):
            add("ip", m.start(), m.end())
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            add("card", m.start(), m.end())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                add("phone", m.start(), m.end())
    for a, b in ibans(text):
        add("iban", a, b)
    for m in SSN.finditer(text):
        add("ssn", m.start(), m.end())
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def span_array(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans] for spans in rows], SPAN_ARROW)


def span_columns(df: DataFrame, search: Callable[[str], list[tuple]], text_col: str, out: str, keep: list[str] | None) -> DataFrame:
    def make() -> Callable:
        return lambda col: [span_array([search(t) for t in texts_of(col)])]

    return add_columns(df, [T.StructField(out, T.ArrayType(SPAN))], [text_col], make, keep)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """Append ``out``: array of (kind, start, end, score), code points, end exclusive, of each whole text.

    Null and empty texts have no spans.  Repeated rows are searched alike; all columns (or ``keep``)
    are carried, one named ``out`` is replaced.  An empty table stays empty.  Failing matches of
    the base kinds are dropped without another try.  Patterns have no nested repetition, so long texts take linear time.
    """
    return span_columns(docs, find, text_col, out, keep)
