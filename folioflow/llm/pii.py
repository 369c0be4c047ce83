"""Personal data: fixed base patterns, and a semi-Markov conditional random field.

The field works on regions, runs of white-space tokens around digits, at-signs and their
spelled-out forms. A candidate segment is any run of up to `LONGEST` tokens of a region, of
any entity type or outside; its features describe the whole span (its shape, counts of
digits, groups and letters, check digits, the words before it). Dynamic programming over segment ends
with that bound on length gives the partition function for training and the jointly best
boundaries and types for decoding.

It is trained on a bounded sample: cases, short lines around base matches whose matches are their gold
segmentation, copies of them in forms the patterns miss (phones without the plus sign or with dots, cards
grouped by other signs, addresses with bracketed dots, spelled-out at-signs and dots), and regions without any match.
Decoded spans that touch no base span are added; base spans stay.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package
from ._spans import Span, digest, in_code_points, joined

KINDS = ("email", "ip", "card", "phone")
RESULT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
#: Tokens of a segment at most (of an entity that is added; base spans have no bound).
LONGEST = 9
#: Digits of an entity without an at-sign: what the kinds allow.
FEWEST, MOST = 4, 19
#: Bounds of the training sample: documents; cases of a kind and of none in a document; bytes of a case
#: (entities or regions that are longer teach nothing); cases of a kind and of none in all.
SAMPLE, PER_DOC, CASE_BYTES, PER_KIND = 400, 5, 300, 60

_LOCAL = bytes(int(chr(c).isalnum() or chr(c) in "._%+-") if c < 128 else 0 for c in range(256))
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(data: bytes) -> Iterator[Span]:
    # a match's local part lies between at-signs, so the leftmost match for each at-sign starts
    # at the first local character behind the one before, and no start is tried twice
    end, at, last = 0, data.find(b"@"), -1
    while at >= 0:
        floor, a = max(end, last + 1), at
        while a > floor and _LOCAL[data[a - 1]]:
            a -= 1
        if a < at and (m := _DOMAIN.match(data, at + 1)):
            end = m.end()
            yield "email", a, end
        last, at = at, data.find(b"@", at + 1)


def base_spans(data: bytes) -> list[Span]:
    """Spans of the fixed patterns in bytes, by kind and then start."""
    found: list[Span] = list(_emails(data))
    if len(data.translate(None, _NOT_DIGITS)) < 4:
        return found
    for m in _CHAIN.finditer(data):
        parts = m[0].split(b".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                found.append(("ip", at, at + size))
            at += size + 1
    for m in _CARD.finditer(data):
        digits = m[0].translate(None, _NOT_DIGITS) if m.end() - m.start() <= 37 else b""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    at = data.find(b"+")
    while at >= 0:
        m = _PHONE.match(data, at)
        if m and 9 <= len(m[0].translate(None, _NOT_DIGITS)) <= 15:
            found.append(("phone", at, m.end()))
        at = data.find(b"+", m.end() if m else at + 1)
    return found


# --- regions -----------------------------------------------------------------------------

_ANCHOR = re.compile(rb"[0-9]|@|\(at\)|\[at\]|\(dot\)|\[dot\]", re.IGNORECASE)
_SPELLED = re.compile(rb"(?<!\S)(?:at|dot)(?!\S)", re.IGNORECASE)
_BRACKETED, _SIGNS = (b"(at)", b"[at]", b"(dot)", b"[dot]"), b"-./_"
_TOKEN = re.compile(rb"\S+")
_LEAD, _TRAIL = b"\"'<[{,;:|", b".,;:!?\"'>]}#%*&$|"
_LINE = re.compile(rb"[^\n]+")


def regions(data: bytes) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens, as (start, end) without outer punctuation, each next to an anchor: a token
    with a digit or an at-sign in any form, or a spelled-out `at` in a line with a `dot`."""
    plain = len(data.translate(None, _NOT_DIGITS)) == 0 and b"@" not in data
    low = data.lower() if plain else b""
    if plain and b" dot " not in low and b"(at)" not in low and b"[at]" not in low:
        return
    for line in _LINE.finditer(data):
        part = line[0]
        spelled = b" dot " in part.lower()
        if not (_ANCHOR.search(part) or spelled):
            continue
        tokens = [(line.start() + m.start(), line.start() + m.end()) for m in _TOKEN.finditer(part)]
        marks = [bool(_ANCHOR.search(data, a, b)) for a, b in tokens]
        for i in range(1, len(tokens) - 1):
            # a lone sign between digits, and the neighbours of a bracketed word, belong to what they join
            a, b = tokens[i]
            if marks[i - 1] and marks[i + 1] and not data[a:b].translate(None, _SIGNS):
                marks[i] = True
            elif data[a:b].lower() in _BRACKETED:
                marks[i - 1] = marks[i + 1] = True
        if spelled:
            words = [data[a:b].lower() for a, b in tokens]
            for i, w in enumerate(words):
                if w == b"dot" and any(x == b"at" for x in words[max(0, i - 6) : i]):
                    for j in range(max(0, i - 4), min(len(words), i + 2)):
                        marks[j] = True
        i = 0
        while i < len(tokens):
            if not marks[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(tokens) and marks[j + 1]:
                j += 1
            out = []
            for a, b in tokens[max(0, i - 2) : j + 2]:
                while a < b and data[a] in _LEAD:
                    a += 1
                while b > a and data[b - 1] in _TRAIL:
                    b -= 1
                if a < b:
                    out.append((a, b))
            if out:
                yield out
            i = j + 2


# --- the field ---------------------------------------------------------------------------

_SHAPES = bytes.maketrans(bytes(range(256)), bytes(57 if 48 <= c <= 57 else 97 if 97 <= c <= 122 or 65 <= c <= 90 or c > 127 else c for c in range(256)))
_GROUPS = re.compile(rb"[0-9]+")
_SQUEEZE = re.compile(rb"(.)\1+", re.DOTALL)


def span_features(data: bytes, region: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the tokens i to j (exclusive) as one span."""
    a, b = region[i][0], region[j - 1][1]
    s = data[a:b]
    digits = s.translate(None, _NOT_DIGITS)
    n, letters = len(digits), len(s.translate(None, _NOT_LETTERS))
    low = s.lower() if letters else b""
    spelled = low.split() if letters else ()
    shape = _SQUEEZE.sub(rb"\1", s.translate(_SHAPES)).decode("ascii", "replace")
    parts = digits and [p for p in s.split(b".") if p]
    quad = bool(digits) and len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts)
    out = [
        f"n={min(n, 20)}", f"tokens={j - i}", f"shape={shape}", f"letters={min(letters, 3)}", f"quad={quad}",
        f"luhn={13 <= n <= 19 and luhn(digits)}", f"at={b'@' in s or b'at' in spelled or b'(at)' in low or b'[at]' in low}",
        f"dot={b'.' in s or b'dot' in spelled}", f"plus={s[:1] == b'+'}", f"bracket={b'(' in s}", f"hyphen={b'-' in s}",
        f"brackets={b'[.]' in s or b'(.)' in s}", f"groups={min(len(_GROUPS.findall(s)), 6)}",
        f"phonelike={9 <= n <= 15 and not letters}{b'(' in s or b'-' in s or b' ' in s}", f"ends={chr(min(s[0], 127)).isalnum()}{chr(min(s[-1], 127)).isalnum()}",
    ]
    if i:
        p, q = region[i - 1]
        out.append("before=" + data[p:q][-12:].lower().decode("utf-8", "replace").strip(":="))
    return out


class SegmentField:
    """Weights by (type, feature); type None is outside, always one token long."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None) -> None:
        self.weights = weights or {k: {} for k in KINDS}

    def scores(self, data: bytes, region: list[tuple[int, int]]) -> list[list[tuple[int, list[str], list[float]]]]:
        """For each end j the candidates (start i, features, score of each kind), i falling: segments that have
        an at-sign in any form, or as many digits as some kind may have."""
        digits, marks = [0], [0]
        for a, b in region:
            token = data[a:b]
            digits.append(digits[-1] + len(token.translate(None, _NOT_DIGITS)))
            marks.append(marks[-1] + (b"@" in token or b"at" in token.lower()))
        out: list[list[tuple[int, list[str], list[float]]]] = [[] for _ in range(len(region) + 1)]
        weights = list(self.weights.values())
        for j in range(1, len(region) + 1):
            for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                if marks[j] > marks[i] or FEWEST <= digits[j] - digits[i] <= MOST:
                    f = span_features(data, region, i, j)
                    out[j].append((i, f, [sum([w.get(x, 0.0) for x in f]) + w.get("bias", 0.0) for w in weights]))
        return out

    def decode(self, data: bytes, region: list[tuple[int, int]]) -> list[Span]:
        """Best segmentation; shorter last segments and earlier kinds win ties."""
        best: list[tuple[float, int, str | None]] = [(0.0, 0, None)]
        for j, cells in enumerate(self.scores(data, region)[1:], 1):
            top = (best[j - 1][0], j - 1, None)
            for i, _, scores in cells:
                for kind, s in zip(KINDS, scores, strict=True):
                    if best[i][0] + s > top[0] + 1e-12:
                        top = (best[i][0] + s, i, kind)
            best.append(top)
        out, j = [], len(region)
        while j:
            _, i, kind = best[j]
            if kind:
                out.append((kind, region[i][0], region[j - 1][1]))
            j = i
        return out[::-1]

    def expected(self, cells: list[list[tuple[int, list[str], list[float]]]]) -> tuple[float, list[tuple[int, int, list[str], list[float]]]]:
        """Log of the partition function, and the probability of each kind for each candidate."""
        n = len(cells) - 1
        ahead = [0.0]
        for j in range(1, n + 1):
            ahead.append(_logsum([ahead[j - 1], *(ahead[i] + s for i, _, scores in cells[j] for s in scores)]))
        # what follows a place is passed on from the ends backwards
        behind: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
        back, out = [0.0] * (n + 1), []
        for j in range(n, -1, -1):
            back[j] = _logsum(behind[j])
            if j:
                behind[j - 1].append(back[j])
            for i, f, scores in cells[j]:
                behind[i] += [back[j] + s for s in scores]
                out.append((i, j, f, [math.exp(min(0.0, ahead[i] + s + back[j] - ahead[n])) for s in scores]))
        return ahead[n], out

    def gradient(self, data: bytes, region: list[tuple[int, int]], gold: dict[tuple[int, int], str], rate: float) -> None:
        """One step along the conditional likelihood's gradient: gold less expected features."""
        for i, j, f, chances in self.expected(self.scores(data, region))[1]:
            for kind, chance in zip(KINDS, chances, strict=True):
                step = (gold.get((i, j)) == kind) - chance
                if abs(step) > 1e-3:
                    w = self.weights[kind]
                    for x in [*f, "bias"]:
                        w[x] = (w.get(x, 0.0) + rate * step) * 0.9995


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def forms(kind: str, s: bytes) -> list[bytes]:
    """An entity as matched, and in forms that the patterns miss."""
    if kind == "phone":
        digits = s.translate(None, _NOT_DIGITS)
        return [s, s[1:], s.split(b" ", 1)[-1], b".".join([digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]]).strip(b"."), b"-".join([digits[-10:-7], digits[-7:-4], digits[-4:]])]
    if kind == "email":
        name, _, host = s.partition(b"@")
        return [s, name + b" at " + host.replace(b".", b" dot "), name + b" [at] " + host, name + b"(at)" + host, name + b" (at) " + host.replace(b".", b" (dot) ")]
    if kind == "ip":
        return [s, s.replace(b".", b"[.]"), s.replace(b".", b"(.)")]
    digits = s.translate(None, _NOT_DIGITS)
    four = [digits[k : k + 4] for k in range(0, len(digits), 4)]
    return [s, b".".join(four), b"/".join(four), b" - ".join(four), b"_".join(four)]


Case = tuple[bytes, str, int, int]
#: Lines with numbers and signs that are no entities, beside those of the documents.
PLAIN = (
    b"on 2024-01-15 we met", b"born 03.11.1987 in", b"from 1998-2004 and", b"at 10:30 or 22.45", b"1,200 units at 3.50 dollars in 12 shops", b"version 1.2.3 of 2019",
    b"look at 40 pages", b"meet at 7 in room 4.12", b"pages 112-118 and 1204-1230", b"ISBN 978-3-16-148410-0 of", b"order 1234567890123456 was", b"chapter 3.1.4 of 10", b"10 000 000 people", b"5.25 at dot 7", b"id 20240115093000 in",
)


def cases(data: bytes) -> list[Case]:
    """Training cases of one document, `PER_DOC` of a kind and of none at most: (line, kind, start, end), a match
    among up to two words of its line on either side; a region without any entity has kind ""."""
    base, out, seen = base_spans(data), [], Counter()
    for kind, a, b in base:
        left, right = data[max(0, a - 30) : a].split(b"\n")[-1].rsplit(b" ", 2)[-2:], data[b : b + 30].split(b"\n")[0].split(b" ")[:2]
        if seen[kind] < PER_DOC and b - a <= CASE_BYTES:
            seen[kind] += 1
            head = b"".join(x + b" " for x in left if x)
            out.append((head + data[a:b] + b" " + b" ".join(x for x in right if x), kind, len(head), len(head) + b - a))
    covered = Cover(base)
    for region in regions(data):
        a, b = region[0][0], region[-1][1]
        # a region is a negative case only if no token of it would be an entity by itself, and nothing is spelled out
        if b - a <= CASE_BYTES and not covered.meets(a, b) and b" dot " not in data[a:b].lower() and not any(base_spans(data[x:y]) for x, y in region):
            out.append((data[a:b], "", 0, 0))
            seen[""] += 1
            if seen[""] == PER_DOC:
                break
    return out


class Cover:
    """The union of spans, for look-ups."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def train(found: list[Case], rounds: int = 6, per_kind: int = PER_KIND) -> SegmentField:
    """Fit on cases, the first `per_kind` of a kind in all its forms, and as many without an entity as there are then (`PLAIN` first, four times);
    without any entity the field finds nothing."""
    field, steps, seen, plain = SegmentField(), [], Counter(), 4 * list(PLAIN)
    for line, kind, a, b in found:
        if not kind:
            plain.append(line)
            continue
        seen[kind] += 1
        if seen[kind] <= per_kind:
            for form in forms(kind, line[a:b]):
                changed = line[:a] + form + line[b:]
                for region in regions(changed):
                    starts, ends = {x: i for i, (x, _) in enumerate(region)}, {y: i + 1 for i, (_, y) in enumerate(region)}
                    if a in starts and a + len(form) in ends and ends[a + len(form)] - starts[a] <= LONGEST:
                        steps.append((changed, region, {(starts[a], ends[a + len(form)]): kind}))
    # plain cases among the others, so that neither kind has the last word
    plain = [(line, region, {}) for line in plain[: len(steps)] for region in regions(line)]
    every = max(1, len(steps) // max(1, len(plain)))
    mixed = [x for k, step in enumerate(steps) for x in (step, *(plain[k // every : k // every + 1] if k % every == 0 else ()))]
    mixed += plain[-(-len(steps) // every) :]
    for k in range(rounds):
        for line, region, gold in mixed:
            field.gradient(line, region, gold, 0.2 / (1 + k))
    return field


def find(field: SegmentField, data: bytes) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together, by kind and then start, in code points."""
    base = base_spans(data)
    taken, extra = Cover(base), []
    for region in regions(data):
        if not all(taken.meets(x, y) for x, y in region):
            extra += [s for s in field.decode(data, region) if not taken.meets(s[1], s[2])]
    both = sorted({*base, *extra}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return in_code_points(data, base), in_code_points(data, both)


def case_column(text: Column) -> Column:
    @arrow_udf("array<struct<line:binary,kind:string,a:int,b:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("line", pa.binary()), ("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            yield pa.array([[dict(zip(("line", "kind", "a", "b"), c, strict=True)) for c in cases(x.as_buffer().to_pybytes())] if x.is_valid else [] for x in batch], kind)

    return run(text.cast("binary"))


def find_column(field: SegmentField, text: Column) -> Column:
    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                base, both = find(field, x.as_buffer().to_pybytes() if x.is_valid else b"")
                rows.append((*[sum(s[0] == k for s in base) for k in KINDS], digest(base), joined(both), len(both) - len(set(base))))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True)], [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run(text.cast("binary"))


def find_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All columns of docs and `pii`, the struct of base counts, base digest,
    all spans and the number of added ones. Null text counts
    as empty; each row on its own, so repeated rows agree and an empty table stays empty; a column
    named pii is replaced. The field is fitted on cases of at most `sample` documents that have digits or an
    at-sign, the first distinct ones by a hash of their text, however long."""
    ship_package(docs.sparkSession)
    # two passes, so that tasks send hashes and only the chosen documents' short cases reach the driver; copies count once
    known = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").rlike("[0-9@]"))
    chosen = [r.h for r in known.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = known.where(F.col("h").isin(chosen)).select("h", case_column(F.col("text")).alias("found")).groupBy("h").agg(F.min_by("found", F.lit(0)).alias("found")).orderBy("h").collect() if chosen else []
    field = train([(bytes(c.line), c.kind, c.a, c.b) for r in rows for c in r.found])
    return docs.withColumn("pii", find_column(field, F.col("text")))
