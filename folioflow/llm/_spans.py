"""Byte offsets to code points, and span lists as text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[str, int, int]


def in_code_points(data: bytes, spans: Iterable[Span]) -> list[Span]:
    """Spans with byte offsets of UTF-8 data, given in code points."""
    spans = list(spans)
    if data.isascii():
        return spans
    where, at, seen = {}, 0, 0
    for x in sorted({o for _, a, b in spans for o in (a, b)}):
        seen += len(data[at:x].decode("utf-8", "replace"))
        where[x], at = seen, x
    return [(k, where[a], where[b]) for k, a, b in spans]


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
