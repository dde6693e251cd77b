"""Secret scan with multipart credential linking.

Strong findings stand alone: assignments to secret names, access identifiers and long hex runs.
Weak candidates (short assigned values, unnamed random-looking keys, user names, endpoints) say
nothing alone. They are interval-joined within their scope, a paragraph and a reach of
characters around: a weak secret is reported if an identifier or an endpoint lies in its scope,
and a user name or endpoint if a secret does.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from paychain.llm.common import with_columns

#: The kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "short", "key", "user", "endpoint")
BASE = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_KEY, REACH = 12, 18, 16, 32, 300

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}")
USER = re.compile(r"""(?:client_id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?""", re.I | re.A)
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_IS_HEX = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
_IS_KEY = bytes(49 if chr(c).isascii() and (chr(c).isalnum() or c in b"+/") else 48 for c in range(256))


def _linked(spans: list[tuple[int, int]], others: list[tuple[int, int]], breaks: list[tuple[int, int]], reach: int) -> tuple[set[int], set[int]]:
    """Positions in ``spans`` that have one of ``others`` in scope, and those positions in ``others``."""
    starts, ends, ours, edges = [s for s, _ in others], [e for _, e in others], set(), [0] * (len(others) + 1)
    begins = [s for s, _ in breaks]
    for k, (s, e) in enumerate(spans):
        p = bisect_right(begins, s)
        low = max(s - reach, breaks[p - 1][1] if p else 0)
        high = min(e + reach, begins[p] if p < len(breaks) else e + reach)
        i, j = bisect_left(ends, low), bisect_right(starts, high)
        if i < j:
            ours.add(k)
            edges[i] += 1
            edges[j] -= 1
    theirs, depth = set(), 0
    for i in range(len(others)):
        depth += edges[i]
        if depth:
            theirs.add(i)
    return ours, theirs


def find_spans(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed in KINDS."""
    named = [(m.span(), len(m[2])) for m in ASSIGN.finditer(text)]
    found = {
        "assign": [s for s, n in named if n >= MIN_VALUE],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS],
        "hex": [m.span() for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX],
    }
    taken = sorted(x for k in BASE for x in found[k])
    begins = [s for s, _ in taken]
    furthest = list(accumulate((e for _, e in taken), max))

    def clear(s: int, e: int) -> bool:
        """No base span meets this one."""
        n = bisect_left(begins, e)
        return not n or furthest[n - 1] <= s

    short = [s for s, n in named if n < MIN_VALUE]
    keys = [m.span() for m in KEY.finditer(text) if clear(*m.span()) and len({(c.isupper(), c.islower(), c.isdigit()) for c in m[0]}) >= 3]
    if short or keys or any(found.values()):
        users = [m.span() for m in USER.finditer(text) if clear(*m.span())]
        endpoints = [m.span() for m in ENDPOINT.finditer(text) if clear(*m.span())]
        breaks = [m.span() for m in PARAGRAPH.finditer(text)]
        secrets = {"assign": found["assign"], "hex": found["hex"], "short": short, "key": keys}
        hit = {k: set() for k in KINDS}
        for k, spans in secrets.items():
            for other, there in (("access", found["access"]), ("user", users), ("endpoint", endpoints)):
                ours, theirs = _linked(spans, there, breaks, reach)
                hit[k] |= ours
                hit[other] |= theirs
        for k, spans in (("short", short), ("key", keys), ("user", users), ("endpoint", endpoints)):
            found[k] = [spans[i] for i in sorted(hit[k])]
    return sorted(((k, s, e) for k, spans in found.items() for s, e in spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_bytes(text: bytes | None, reach: int = REACH) -> list[tuple[str, int, int]]:
    """find_spans, decoding only texts that hold what any finding needs."""
    if not text:
        return []
    if b"AKIA" not in text and b"1" * MIN_HEX not in text.translate(_IS_HEX) and b"1" * MIN_KEY not in text.translate(_IS_KEY):
        low = text.lower()
        if not any(n in low for n in _NAMES):
            return []
    return find_spans(text.decode("utf-8", "replace"), reach)


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """``keep`` columns (all by default) and ``spans``: array<struct<kind, start, end>> of each whole text.

    Spans are in code points, end exclusive, ordered by start and kind. Null and empty texts have none.
    Repeated rows are scanned each; a column of the same name as the new one gives way to it.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(texts: list[bytes | None], _) -> list:
        return [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in scan_bytes(t, reach)] for t in texts], kind)]

    return with_columns(docs, docs.columns if keep is None else keep, text, scan, "spans array<struct<kind: string, start: int, end: int>>", ["spans"])
