"""Secrets in whole texts: strong patterns, and multipart credentials linked by an interval join.

Access identifiers, secrets and endpoints each open an interval around themselves that reaches to
the ends of their scope (a run of lines without a blank line).  Strong finds are always reported; a
weak candidate only when the interval of a complementary part overlaps its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import inf, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pii import span_columns
from .runtime import add_columns, texts_of

BASE = ("assign", "access", "hex")
#: Weak kinds: an account identifier, a high-entropy token, an endpoint.
KINDS = (*BASE, "account", "entropy", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "entropy": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
#: Code points that an interval reaches beyond its part before the scope clips it: only the scope limits linking.
REACH = inf

ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ACCOUNT = re.compile(r"(?ai:client_?id|user(?:_?name)?|login|account|access_?key_?id)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9@._-]{3,}+)")
ENTROPY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+")
ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:@-]{3,}+|(?ai:host(?:name)?|endpoint|server)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9._:-]{3,}+")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
LEAST_BITS = 4.0


def bits(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values())


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, strength) by start, then kind as in KINDS."""
    strong = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        strong += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    strong += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    weak = [("entropy", m.start(), m.end()) for m in ENTROPY.finditer(text) if any(c.isdigit() for c in m[0]) and bits(m[0]) >= LEAST_BITS]
    if ":" in text or "=" in text:
        weak += [("account", m.start(), m.end()) for m in ACCOUNT.finditer(text)]
        weak += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    out = [(k, a, b, 1.0) for k, a, b in strong]
    if weak:
        out += [(k, a, b, 0.5) for k, a, b in linked(weak, strong, text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def linked(weak: list[tuple[str, int, int]], strong: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """Weak parts whose interval meets that of a part of another role, a secret among the two.

    Within a scope every interval is its span widened by the same reach, so two of them meet exactly
    if the nearest parts on either side do: parts are sorted once and each weak one probes its
    neighbours, farthest end first by a running maximum.
    """
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    parts: dict[str, list[tuple[int, int, int]]] = {r: [] for r in ("identifier", "secret", "endpoint")}
    for k, a, b in [*weak, *strong]:
        parts[ROLE[k]].append((bisect_left(breaks, a + 1), a, b))
    tops: dict[str, list[tuple[int, int]]] = {}
    for r, own in parts.items():
        own.sort()
        top: list[tuple[int, int]] = []
        for scope, _, b in own:
            top.append((scope, max(b, top[-1][1]) if top and top[-1][0] == scope else b))
        tops[r] = top

    def meets(role: str, scope: int, a: int, b: int) -> bool:
        i = bisect_left(parts[role], (scope, b + 2 * REACH + 1, -1)) - 1  # the last that starts in time
        return i >= 0 and tops[role][i][0] == scope and tops[role][i][1] >= a - 2 * REACH

    out = []
    for k, a, b in weak:
        scope = bisect_left(breaks, a + 1)
        wanted = ("identifier", "endpoint") if ROLE[k] == "secret" else ("secret",)
        if any(meets(r, scope, a, b) for r in wanted):
            out.append((k, a, b))
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """Append ``out``: array of (kind, start, end, score), code points, end exclusive, of each whole text.

    Null and empty texts have no spans.  Repeated rows are searched alike; all columns (or ``keep``)
    are carried, one named ``out`` is replaced.  An empty table stays empty.
    """
    return span_columns(docs, find, text_col, out, keep)


def redact(text: str) -> str:
    """``text`` with every found span as ``<kind>``; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b, _ in find(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by its kind in angle brackets.

    Null stays null, an empty text empty; repeated rows are masked alike, an empty table stays empty.
    Other columns are untouched, whatever their names.
    """
    import pyarrow as pa

    def make():
        return lambda col: [pa.array([None if t is None else redact(t) for t in col.to_pylist()], pa.string())]

    order = docs.columns
    return add_columns(docs, [T.StructField(text_col, T.StringType())], [text_col], make).select(*[F.col(f"`{c}`") for c in order])
