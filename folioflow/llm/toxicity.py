"""Toxicity by a linear-chain conditional random field over word tokens.

Documents are labelled, tokens are not: token labels come from the training documents. A
feature (the lower-cased word, or its first 3 to 8 letters if more follow) is a cue when its document counts
in the two classes could hardly arise by chance (near copies counted once; binomial tail under the base rate, false
discoveries held to a small share). Tokens of toxic training documents that carry a cue are
labelled toxic, all others clean; the chain is then trained on those labelled tokens by
maximum conditional likelihood. Forward-backward marginals give each token's probability, a
document's score is a logistic map of their largest value and their sum, and runs of tokens
with a marginal of at least one half are the offending spans.

The model is fitted on a bounded sample of labelled rows (`PER_CLASS` rows of either class,
chosen by a hash of the id); scoring runs over every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package
from .simhash import fingerprint

#: Bound of the training sample: so many labelled rows of either class at most.
PER_CLASS = 1000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Share of cues that may be there by chance, and least share of toxic documents among those that hold a cue.
FALSE, PURE = 0.02, 0.5
#: Words of a slice that is scored at once, and words of a block of the scan.
SLICE, BLOCK = 100_000, 256
#: A worker forgets its word cache beyond this many words.
CACHE = 100_000
SPAN_RESULT = "score double, n_spans int, spans string"

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Letter runs of UTF-8 text, A-Z in lower case; every byte keeps its place."""
    return text.translate(_TABLE).split()


def features(token: bytes) -> list[str]:
    word = token.decode("utf-8", "replace").lower()
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def scan(m00: np.ndarray, m01: np.ndarray, m10: np.ndarray, m11: np.ndarray) -> np.ndarray:
    """x[t] = (m00[t] x[t-1] + m01[t]) / (m10[t] x[t-1] + m11[t]) from x[-1] = 1, in blocks:
    all blocks advance together, first to find what each does to its entry value, then to
    fill in the values."""
    n = len(m00)
    k = max(1, -(-n // BLOCK))
    pad = k * BLOCK - n
    cells = [np.concatenate([x, np.full(pad, d)]).reshape(k, BLOCK).T.copy() for x, d in ((m00, 1.0), (m01, 0.0), (m10, 0.0), (m11, 1.0))]
    a, b, c, d = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
    for t in range(BLOCK):
        p, q, r, s = (x[t] for x in cells)
        a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    x, entry = 1.0, np.empty(k)
    for j, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        entry[j] = x
        x = (p * x + q) / (r * x + s)
    out = np.empty((BLOCK, k))
    for t in range(BLOCK):
        p, q, r, s = (x[t] for x in cells)
        entry = (p * entry + q) / (r * entry + s)
        out[t] = entry
    return out.T.reshape(-1)[:n]


@dataclass
class ToxicityModel:
    """Weights of the chain: log-odds of the toxic label for each feature, bias and transitions
    (from clean to toxic, from toxic to toxic, as log-odds against clean), and the document map."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    enter: float = -4.0
    stay: float = 0.0
    document: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def __post_init__(self) -> None:
        self.index()

    def index(self) -> None:
        self.words = {f[1:]: x for f, x in self.weights.items() if f[0] == "="}
        self.starts = {k: {f[1:]: x for f, x in self.weights.items() if f[0] == "^" and len(f) == k + 1} for k in PREFIXES}

    def emission(self, token: bytes) -> float:
        word = token.decode("utf-8", "replace").lower()
        out, n = self.bias + self.words.get(word, 0.0), len(word)
        for k, starts in self.starts.items():
            if n <= k:
                break
            if (x := starts.get(word[:k])) is not None:
                out += x
        return out

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of the toxic label for each token of concatenated documents."""
        e, first, forward, back = self._passes(emissions, sizes)
        both = forward * back
        return both / (1 + both)

    def pairs(self, emissions: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities that a token is toxic behind a clean one (or at a document's start), and that it is
        toxic behind a toxic one: the forward-backward marginals of neighbouring labels."""
        e, first, forward, back = self._passes(emissions, sizes)
        before = np.where(first, 0.0, np.concatenate([[0.0], forward[:-1]]))
        enter, stay = math.exp(self.enter) * e * back, math.exp(self.stay) * e * back * before
        whole = enter + stay + 1 + before
        return enter / whole, stay / whole

    def _passes(self, emissions: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Odds of each token, whether it begins a document, and the forward and backward odds of the toxic label."""
        n = len(emissions)
        if not n:
            return (np.zeros(0),) * 4
        e = np.exp(np.clip(emissions, -30, 30))
        ot, tt = math.exp(self.enter), math.exp(self.stay)
        sizes = sizes[sizes > 0]
        first = np.zeros(n, bool)
        ends = np.cumsum(sizes)
        first[ends - sizes] = True
        inside = ~first
        forward = scan(e * tt * inside, e * ot, inside * 1.0, np.ones(n))
        last = np.zeros(n, bool)
        last[ends - 1] = True
        after = np.where(last, 0.0, np.concatenate([e[1:], [0.0]]))[::-1]
        back = scan(after * tt, np.ones(n), after * ot, np.ones(n))[::-1]
        return e, first, forward, back

    def score(self, peak: np.ndarray, total: np.ndarray) -> np.ndarray:
        b0, b1, b2 = self.document
        peak = np.clip(peak, 1e-9, 1 - 1e-9)
        return 1 / (1 + np.exp(-np.clip(b0 + b1 * np.log(peak / (1 - peak)) + b2 * np.log1p(total), -40, 40)))


def _tail(k: int, n: int, p: float) -> float:
    """Log probability of k or more hits in n draws, to its leading term."""
    if k / n <= p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def _cues(docs: list[list[list[str]]], toxic: list[int]) -> set[str]:
    """docs: the features of each distinct word of each document, the word itself first. Prefixes
    are counted over the words that are no cues themselves, so one frequent word makes no stem.
    Of the cues a share of `FALSE` at most is expected to be there by chance (step-up over the sorted tails)."""
    base, found = max(1, sum(toxic)) / max(2, len(toxic)), set()
    for part in (slice(0, 1), slice(1, None)):
        counts = {0: Counter(), 1: Counter()}
        for lists, y in zip(docs, toxic, strict=True):
            counts[y].update({x for f in lists if f[0] not in found for x in f[part]})
        tried = sorted((_tail(k, k + counts[0][f], base), f) for f, k in counts[1].items() if k >= 3)
        last = max((r for r, (tail, _) in enumerate(tried, 1) if tail <= math.log(FALSE * r / len(tried))), default=0)
        found |= {f for _, f in tried[:last] if counts[1][f] >= PURE * (counts[1][f] + counts[0][f])}
    return found


def distinct(texts: list[bytes], radius: int = 8) -> list[bool]:
    """Whether a text is the first of its near copies: copies are no independent evidence for a cue."""
    prints = np.array([fingerprint(t) for t in texts], np.uint64)
    return [not (np.bitwise_count(prints[:k] ^ x) <= radius).any() for k, x in enumerate(prints)]


def gradient(model: ToxicityModel, theta: np.ndarray, token: np.ndarray, feature: np.ndarray, gold: np.ndarray, prior: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Gradient of the labels' conditional log-likelihood: features, bias, enter and stay, as they occur in gold
    less as the chain expects them. theta holds those weights; token and feature are the pairs that
    occur, prior is gold of the token before in its document."""
    n = len(gold)
    model.bias, model.enter, model.stay = theta[-3:]
    e = model.bias + (np.bincount(token, theta[feature], n) if len(feature) else np.zeros(n))
    enter, stay = model.pairs(e, sizes)
    off = gold - (enter + stay)
    features = np.bincount(feature, off[token], len(theta) - 3) if len(feature) else np.zeros(len(theta) - 3)
    return np.concatenate([features, [off.sum(), (gold & ~prior).sum() - enter.sum(), (gold & prior).sum() - stay.sum()]])


def fit(rows: list[tuple[str, int]], weight: dict[int, float] | None = None, rounds: int = 24) -> ToxicityModel:
    """rows: (text, toxic 0 or 1). weight: rows of the corpus that a row of either class stands
    for. Without both classes the model scores the base rate."""
    weight = weight or {0: 1.0, 1: 1.0}
    toxic = [y for _, y in rows]
    model = ToxicityModel()
    if not 0 < sum(toxic) < len(toxic):
        model.document = (-40.0 if not sum(toxic) else 40.0, 0.0, 0.0)
        return model
    texts = [tokens((t or "").encode("utf-8", "replace")) for t, _ in rows]
    own_text = distinct([(t or "").encode("utf-8", "replace") for t, _ in rows])
    held = [i % 3 == 2 for i in range(len(rows))] if sum(toxic) >= 90 else [False] * len(rows)
    types: dict[bytes, list[str]] = {w: features(w) for ws in texts for w in ws}
    seen = [k for k, (h, own) in enumerate(zip(held, own_text, strict=True)) if own and not h]
    cues = _cues([[types[w] for w in set(texts[k])] for k in seen], [toxic[k] for k in seen])
    names = sorted(cues)
    place = {f: i for i, f in enumerate(names)}
    own = {w: [place[f] for f in fs if f in place] for w, fs in types.items()}
    train = [i for i, h in enumerate(held) if not h]
    sizes = np.array([len(texts[i]) for i in train])
    lists = [own[w] for i in train for w in texts[i]]
    gold = np.concatenate([np.full(len(texts[i]), toxic[i]) for i in train]).astype(bool) & np.array([bool(x) for x in lists])
    token = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.array([f for x in lists for f in x], np.int64)
    # gradient steps by sign (Rprop): features, bias, enter, stay; L2 keeps separable weights finite
    theta = np.concatenate([np.full(len(names), 2.0), [-6.0, -4.0, 0.0]])
    step, before = np.full(len(theta), 0.25), np.zeros(len(theta))
    sizes_in = sizes[sizes > 0]
    ends = np.cumsum(sizes_in)
    follows = np.ones(len(lists), bool)
    follows[ends - sizes_in] = False
    prior = np.concatenate([[False], gold[:-1]]) & follows
    for _ in range(rounds):
        grad = gradient(model, theta, token, feature, gold, prior, sizes) - 0.02 * theta
        same = grad * before
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        before = np.where(same < 0, 0.0, grad)
        theta = np.clip(theta + np.sign(before) * step, -12, 12)
    model.weights = {f: float(x) for f, x in zip(names, theta[: len(names)], strict=True)}
    model.bias, model.enter, model.stay = map(float, theta[-3:])
    model.index()
    check = [i for i, h in enumerate(held) if h] or train
    peak, total = summary(model, [texts[i] for i in check])
    y = np.array([toxic[i] for i in check], float)
    w = np.array([weight[toxic[i]] for i in check])
    model.document = _logistic(np.log(np.clip(peak, 1e-9, 1 - 1e-9) / (1 - np.clip(peak, 1e-9, 1 - 1e-9))), np.log1p(total), y, w / w.mean())
    return model


def _logistic(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    x = np.stack([np.ones(len(y)), x1, x2], axis=1)
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge @ beta * len(y) * 0.05
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * len(y) * 0.05 + np.eye(3) * 1e-6
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    # more marginal mass never lowers a score
    return float(beta[0]), float(max(beta[1], 0.0)), float(max(beta[2], 0.0))


def summary(model: ToxicityModel, docs: list[list[bytes]], cache: dict[bytes, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest marginal and sum of marginals of each document."""
    return _summary(*_marginals(model, docs, {} if cache is None else cache))


def _summary(p: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    peak, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    if len(p):
        full = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[full]
        peak[full], total[full] = np.maximum.reduceat(p, starts), np.add.reduceat(p, starts)
    return peak, total


def _marginals(model: ToxicityModel, docs: list[list[bytes]], cache: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    if len(cache) > CACHE:
        cache.clear()
    sizes = np.array([len(d) for d in docs], np.int64)
    out = np.empty(int(sizes.sum()))
    k = 0
    for d in docs:
        for w in set(d).difference(cache):
            cache[w] = model.emission(w)
        out[k : k + len(d)] = np.fromiter(map(cache.__getitem__, d), float, len(d))
        k += len(d)
    return model.marginals(out, sizes), sizes


def spans_of(text: bytes, p: np.ndarray) -> list[tuple[int, int]]:
    """Runs of tokens at one half or more, as code-point offsets, end exclusive."""
    runs: list[list[int]] = []
    marked = False
    for m, x in zip(re.finditer(rb"\S+", text.translate(_TABLE)), p, strict=True):
        if x >= 0.5 and marked:
            runs[-1][1] = m.end()
        elif x >= 0.5:
            runs.append([m.start(), m.end()])
        marked = x >= 0.5
    out, at, seen = [], 0, 0
    for a, b in runs:
        seen += len(text[at:a].decode("utf-8", "replace"))
        length = len(text[a:b].decode("utf-8", "replace"))
        out.append((seen, seen + length))
        seen, at = seen + length, b
    return out


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Struct of score, n_spans and spans ("start:end" in code points, comma-joined).
    Null and empty texts have no tokens and score as a document without any marginal mass."""

    @arrow_udf(SPAN_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            scores, counts, where = [], [], []
            group: list[bytes] = []

            def flush(group: list[bytes] = group, scores: list = scores, counts: list = counts, where: list = where) -> None:
                p, sizes = _marginals(model, [tokens(x) for x in group], cache)
                ends, (peak, total) = np.cumsum(sizes), _summary(p, sizes)
                scores.extend(model.score(peak, total).tolist())
                for x, top, end, size in zip(group, peak.tolist(), ends.tolist(), sizes.tolist(), strict=True):
                    found = spans_of(x, p[end - size : end]) if top >= 0.5 else []
                    counts.append(len(found))
                    where.append(",".join(f"{a}:{b}" for a, b in found))
                group.clear()

            held = 0
            for x in batch:
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                group.append(data)
                held += len(data)
                if held >= SLICE * 5:
                    flush()
                    held = 0
            flush()
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(where, pa.string())], ["score", "n_spans", "spans"])

    return run(text.cast("binary"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (null without id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most about per_class rows of either class, never on a held-out id.

    Label rows without id or label are left out; an id labelled twice counts as toxic if any
    row says so; ids without a document add nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    part = known.where(F.coalesce(*[F.when(F.col("toxic") == y, share < int(min(1.0, per_class / n) * (1 << 20)) + 1) for y, n in sizes.items()])) if sizes else known.limit(0)
    # the sample's size is bounded by per_class, so it is safe to send to every task and to the driver
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(part.withColumnRenamed("doc_id", "id")), "id").orderBy("id", "text").collect()
    found = Counter(r["toxic"] for r in rows)
    return fit([(r["text"], r["toxic"]) for r in rows], {y: sizes[y] / found[y] for y in found})


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """All columns of docs and `toxicity`, a struct of score, n_spans and spans.

    Every row is scored on its own, so repeated rows get equal scores; empty tables give
    empty tables. A column of docs named toxicity is replaced.
    """
    ship_package(docs.sparkSession)
    return docs.withColumn("toxicity", score_column(train(docs, labels, per_class), F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Filter: documents that score at least `threshold` go; the columns stay as they were."""
    ship_package(docs.sparkSession)
    model = train(docs, labels)
    return docs.where(score_column(model, F.col("text"))["score"] < threshold)
