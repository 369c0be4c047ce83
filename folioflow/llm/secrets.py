"""Secret scan: fixed base patterns, and Shannon entropy in sliding windows.

The entropy part looks at candidate strings, maximal runs of key-like characters. Within one,
every maximal run of a character class (hexadecimal, base64) is swept by a window of fixed
width whose character counts are updated as it moves, so each step costs one table look-up.
Windows at or above the class's threshold merge into spans. The allow-list (what merely looks random) is
applied to a whole candidate, to the parts of a path at its ends, which are cut off before the sweep, and to
each merged span, never to a candidate because of a part of it. Base spans always stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package
from ._spans import Span, digest, in_code_points, joined

KINDS = ("assign", "access", "hex", "entropy")
RESULT = "n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string, redacted string"
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_STARTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Candidate strings: runs of these characters of at least this length.
_KEYLIKE, CANDIDATE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20


@dataclass(frozen=True)
class EntropyClass:
    name: str
    characters: bytes
    window: int
    bits: float


CLASSES = (EntropyClass("hex", b"0123456789abcdefABCDEF", 20, 2.8), EntropyClass("base64", _KEYLIKE, 20, 3.75))
#: What looks random and is no secret: UUIDs, plain numbers, digests named as such, and words without any digit.
ALLOWED = (
    rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    rb"[0-9_+/=-]+",
    rb"(?i)(sha1|sha256|sha384|sha512|md5)[-=].*",
    rb"[A-Za-z_+/=-]+",
)
#: Counting sequences and documentation samples: a part of a path, or a span, that holds one is allowed.
SAMPLES = rb"(?i).*(0123456789|abcdefghij|example|placeholder|changeme).*"
#: A part of a path is made of words if its letter runs are this long on average.
WORD = 3.0


def _members(characters: bytes) -> bytes:
    return bytes(int(c in characters) for c in range(256))


_KEY_TABLE, _HEX_TABLE = _members(_KEYLIKE), _members(b"0123456789abcdef")
_CLASS_TABLES = tuple(_members(c.characters) for c in CLASSES)
_ALLOWED = tuple(re.compile(p, re.DOTALL) for p in ALLOWED)
_SAMPLE, _RUN = re.compile(SAMPLES, re.DOTALL), re.compile(rb"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOGC = [0.0] + [k * math.log2(k) for k in range(1, 1 + max(c.window for c in CLASSES))]


def runs(marks: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of byte 1 of at least that length."""
    probe, at = b"\x01" * least, 0
    while (a := marks.find(probe, at)) >= 0:
        b = marks.find(b"\x00", a + least)
        at = len(marks) if b < 0 else b
        yield a, at


def hot_windows(data: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Union of the windows whose character entropy is at least `bits`, left to right."""
    counts, total, out = [0] * 256, 0.0, []
    for i, c in enumerate(data):
        k = counts[c]
        total += _CLOGC[k + 1] - _CLOGC[k] if k < window else 0.0
        counts[c] = k + 1
        if i >= window - 1:
            if math.log2(window) - total / window >= bits - 1e-12:
                a = i - window + 1
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((a, i + 1))
            old = data[i - window + 1]
            k = counts[old]
            total += _CLOGC[k - 1] - _CLOGC[k]
            counts[old] = k - 1
    return out


def base_spans(data: bytes) -> list[Span]:
    """Spans of the fixed patterns, in bytes, by start and then kind."""
    found: list[Span] = []
    low = data.lower()
    starts = []
    for word in _STARTS:
        at = low.find(word)
        while at >= 0:
            starts.append(at)
            at = low.find(word, at + 1)
    end = 0
    for at in sorted(starts):
        if at >= end and (m := _ASSIGN.match(data, at)):
            end = m.end()
            if len(m[2]) >= 8:
                found.append(("assign", at, end))
    at = data.find(b"AKIA")
    while at >= 0:
        m = _ACCESS.match(data, at)
        if m and m.end() - at >= 16:
            found.append(("access", at, m.end()))
        at = data.find(b"AKIA", m.end() if m else at + 1)
    found += [("hex", a, b) for a, b in runs(data.translate(_HEX_TABLE), 32)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def allowed(data: bytes) -> bool:
    return any(p.fullmatch(data) for p in _ALLOWED)


def plain_part(part: bytes) -> bool:
    """Whether a part of a path is allowed, or a name made of words, digits only at its end."""
    if not part or allowed(part) or _SAMPLE.fullmatch(part):
        return True
    pieces = _RUN.findall(part.rstrip(b"0123456789"))
    return not any(x[:1].isdigit() for x in pieces) and sum(map(len, pieces)) >= WORD * len(pieces)


def swept(whole: bytes) -> tuple[int, int]:
    """The stretch of a candidate that windows sweep: without plain parts at its ends."""
    a, b = 0, len(whole)
    while a < b:
        cut = whole.find(b"/", a, b)
        if not plain_part(whole[a : cut if cut >= 0 else b]):
            break
        a = cut + 1 if cut >= 0 else b
    while a < b:
        cut = whole.rfind(b"/", a, b)
        if not plain_part(whole[cut + 1 if cut >= 0 else a : b]):
            break
        b = cut if cut >= 0 else a
    return a, b


def entropy_spans(data: bytes) -> list[Span]:
    out: list[Span] = []
    for a, b in runs(data.translate(_KEY_TABLE), CANDIDATE):
        if allowed(data[a:b]):
            continue
        lo, hi = swept(data[a:b])
        part, found = data[a + lo : a + hi], []
        for kind, members in zip(CLASSES, _CLASS_TABLES, strict=True):
            for x, y in runs(part.translate(members), kind.window):
                found += [(x + s, x + e) for s, e in hot_windows(part[x:y], kind.window, kind.bits) if not allowed(part[x + s : x + e])]
        merged: list[tuple[int, int]] = []
        for s, e in sorted(found):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        out += [("entropy", a + lo + s, a + lo + e) for s, e in merged if not (allowed(part[s:e]) or _SAMPLE.fullmatch(part[s:e]))]
    return out


def redact(data: bytes, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by [SECRET]."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [data[at:a], b"[SECRET]"]
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def scan_column(text: Column, redacted: bool = False) -> Column:
    """Struct of the counts, the base digest, all spans and (if asked) the redacted text, which is
    null where there is nothing to redact. Null text counts as empty."""

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                base, extra = base_spans(data), entropy_spans(data)
                both = sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))
                n = [sum(s[0] == k for s in both) for k in KINDS]
                rows.append((*n, digest(in_code_points(data, base)), joined(in_code_points(data, both)), redact(data, both) if redacted and both else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "redacted"])

    return run(text.cast("binary"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """All columns of docs and `secrets`, the scan's struct without the redacted text. Each row on
    its own: repeated rows agree, an empty table stays empty; a column named secrets is replaced."""
    ship_package(docs.sparkSession)
    return docs.withColumn("secrets", scan_column(F.col("text")).dropFields("redacted"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every secret in `text` replaced by [SECRET]; a null text stays null."""
    ship_package(docs.sparkSession)
    found = scan_column(F.col("text"), True)["redacted"]
    out = docs.withColumn("text", F.coalesce(found, F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
