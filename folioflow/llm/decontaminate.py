"""Benchmark decontamination by SimHash over item-sized windows.

Benchmark items are a query set: they are read in blocks of bounded size, and every block is
compared with all documents in one scan. For an item of n words, every n-word window of a
document is a candidate place; a document of fewer words is one window as a whole.

1. Posting lists from shingles to items give, for a slice of a document, the items that it could hold:
   those of which it has `THRESHOLD` of the weight. Windows whose known shingles weigh less than
   `THRESHOLD` of the whole are no candidates either. Both are bounds on the similarity, so nothing is lost.
2. The 64-bit SimHash over the weighted shingles of each remaining window is looked up in a multi-index of the slice's
   items: eight byte tables, each entry posted under every byte value within two flips. A fingerprint within
   `RADIUS` = 8 * 3 - 1 differing bits has at least one byte with two flips or fewer, so the
   tables return every item within the radius; the distances of what they return are checked.
3. Exact weighted-shingle similarity (the sum of least over the sum of greatest weighted counts)
   decides: `THRESHOLD` or more is a leak.

Shingles are five words (an item of fewer words is one shingle). A shingle's weight falls with
the number of items of the whole benchmark that hold it, so boilerplate shared by many items counts little; shingles
of no item weigh the most. Long documents are worked on in slices of `WINDOWS` windows, so a task's
memory is bounded by the text, the block of items and one slice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._runtime import ship_package, written

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 23
#: Items compared in one scan, and their UTF-8 bytes together: the bound of what a task holds.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
#: Windows whose fingerprints are held at once.
WINDOWS = 4096
RESULT = "array<struct<item_id:bigint,similarity:double,distance:int,word:int,n_words:int>>"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_P = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_BITS = 20
_NEAR = np.array([[(a ^ b).bit_count() <= 2 for b in range(256)] for a in range(256)])


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text in lower case, without ASCII punctuation."""
    return (text if text.isascii() else text.decode("utf-8", "replace").lower().encode()).translate(_TABLE).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        x = h[k : k + n] * _P[k]
        out += x ^ (x >> np.uint64(29))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(31))


def simhashes(codes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Weighted SimHash of every run of `size` shingles."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    votes = np.cumsum((2 * bits - 1) * weights[:, None], axis=0)
    votes = np.concatenate([np.zeros((1, 64)), votes])
    return np.packbits(votes[size:] - votes[:-size] > 1e-9, axis=1, bitorder="little").view(np.uint64)[:, 0]


def similarity(a: Counter, b: Counter, weight) -> float:
    most = sum(weight(s) * max(a[s], b[s]) for s in a.keys() | b.keys())
    return sum(weight(s) * min(a[s], b[s]) for s in a.keys() & b.keys()) / most if most else 0.0


def parsed(items: list[tuple[int, str]]) -> list[tuple[int, int, np.ndarray]]:
    """(id, words, shingle codes) of the items that have words."""
    out = []
    for i, t in items:
        if ws := words((t or "").encode("utf-8", "replace")):
            out.append((i, len(ws), shingle_hashes(word_hashes(ws), min(SHINGLE, len(ws)))))
    return out


class Items:
    """The index over a block of benchmark items. frequency: how many items of the whole benchmark, which
    has n_items, hold each of the block's shingles; by default the block is the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int] | None = None, n_items: int = 0) -> None:
        group = parsed(items)
        if frequency is None:
            frequency, n_items = Counter(s for _, _, codes in group for s in set(codes.tolist())), len(group)
        self.ids, self.counts, self.codes = [i for i, _, _ in group], [Counter(c.tolist()) for _, _, c in group], [np.unique(c) for _, _, c in group]
        self.most = 1 + math.log1p(max(1, n_items))
        self.weight_of = {s: 1 + math.log1p(n_items / k) - math.log1p(1) for s, k in frequency.items()}
        self.known = np.array(sorted(frequency), np.uint64)
        self.known_weights = np.array([self.weight_of[s] for s in sorted(frequency)])
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.known >> np.uint64(64 - _BITS)] = True
        self.lengths = np.array([n for _, n, _ in group], np.int64)
        short = np.minimum(self.lengths, SHINGLE)
        self.sizes = np.unique(short).tolist()
        # items of each shingle size, and the most words of one
        self.own = {k: short == k for k in self.sizes}
        self.longest = {k: int(self.lengths[own].max()) for k, own in self.own.items()}
        self.prints = np.array([simhashes(c, self.weights(c), len(c))[0] for _, _, c in group], np.uint64)
        self.totals = np.array([float(self.weights(c).sum()) for _, _, c in group])
        # postings: for each known shingle the items that hold it, and what its occurrences weigh there
        at = [(np.searchsorted(self.known, np.fromiter(c, np.uint64, len(c))), np.fromiter(c.values(), np.float64, len(c))) for c in self.counts]
        place = np.concatenate([a for a, _ in at]) if at else np.zeros(0, np.int64)
        order = np.argsort(place, kind="stable")
        self.holder = np.repeat(np.arange(len(group)), [len(a) for a, _ in at])[order] if at else place
        self.share = (np.concatenate([n for _, n in at]) * self.known_weights[place])[order] if at else np.zeros(0)
        self.starts = np.searchsorted(place[order], np.arange(len(self.known) + 1))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code among the known ones, -1 for others."""
        out = np.full(len(codes), -1, np.int64)
        maybe = np.flatnonzero(self.bitmap[codes >> np.uint64(64 - _BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, codes[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == codes[maybe], at, -1)
        return out

    def weights(self, codes: np.ndarray) -> np.ndarray:
        at = self.places(codes)
        return np.where(at >= 0, self.known_weights[at], self.most) if len(self.known) else np.full(len(codes), self.most)

    def weight(self, code: int) -> float:
        return self.weight_of.get(code, self.most)

    def held(self, places: np.ndarray) -> np.ndarray:
        """Items of which the shingles at these places could make up THRESHOLD of the weight."""
        places = np.unique(places)
        a, n = self.starts[places], self.starts[places + 1] - self.starts[places]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        items, where = np.unique(self.holder[at], return_inverse=True)
        return items[np.bincount(where, self.share[at], len(items)) >= THRESHOLD * self.totals[items] * (1 - 1e-9)]

    def leaks(self, text: bytes) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, differing bits, first word, words) of the best window of each item id
        that leaks; of equal windows the first."""
        ws = words(text)
        if not ws or not self.ids:
            return []
        h, found = word_hashes(ws), {}
        for size in self.sizes:
            codes = shingle_hashes(h, size)
            hits = np.flatnonzero(self.places(codes) >= 0) if len(codes) else codes
            if len(hits):
                self._slices(codes, hits, size, found)
        best: dict[int, tuple] = {}
        for k, x in sorted(found.items()):
            i = self.ids[k]
            if i not in best or (-x[0], x[2], x[1]) < (-best[i][0], best[i][2], best[i][1]):
                best[i] = x
        return [(i, *x) for i, x in sorted(best.items())]

    def _slices(self, codes: np.ndarray, hits: np.ndarray, size: int, found: dict) -> None:
        """Slices of the document that could hold items, each with the windows of one item length."""
        at, own, longest = self.places(codes[hits]), self.own[size], self.longest[size]
        for first in range(0, len(codes), WINDOWS):
            # windows that begin in this slice reach longest - size shingles beyond it
            a, b = np.searchsorted(hits, [first, first + WINDOWS + longest - size])
            if a == b:
                continue
            able = self.held(at[a:b])
            able = able[own[able]]
            for length in np.unique(self.lengths[able]).tolist():
                run, items = length - size + 1, able[self.lengths[able] == length]
                if run > len(codes):
                    if not first:  # fewer words than the item: the whole text is the window
                        self._look_up(codes, 0, len(codes), len(codes) + size - 1, items, found)
                    continue
                self._look_up(codes[first : first + WINDOWS + run - 1], first, run, length, items, found)

    def _look_up(self, part: np.ndarray, first: int, run: int, n_words: int, items: np.ndarray, found: dict) -> None:
        if len(part) < run:
            return
        at = self.places(part)
        weights = np.where(at >= 0, self.known_weights[at], self.most)
        sums = np.cumsum(np.stack([weights, np.where(at >= 0, weights, 0.0)]), axis=1)
        whole, known = sums[:, run - 1 :] - np.concatenate([np.zeros((2, 1)), sums[:, : len(part) - run]], axis=1)
        able = np.flatnonzero(known >= THRESHOLD * whole - 1e-9 * sums[0, -1])
        if not len(able):
            return
        # only the stretch from the first to the last such window is voted on
        lo, hi = int(able[0]), int(able[-1]) + run
        marks = simhashes(part[lo:hi], weights[lo:hi], run)[able - lo]
        tables, data = self.prints[items].view(np.uint8).reshape(-1, 8), marks.view(np.uint8).reshape(-1, 8)
        step = max(1, (1 << 22) // len(items))
        for k in range(0, len(able), step):
            near = np.zeros((len(data[k : k + step]), len(items)), bool)
            for b in range(8):  # byte table b: the items posted under each value
                near |= _NEAR[:, tables[:, b]][data[k : k + step, b]]
            where, which = np.nonzero(near)
            distance = np.bitwise_count(marks[k + where] ^ self.prints[items[which]])
            order = np.lexsort((where, distance, which))
            order = order[distance[order] <= RADIUS]
            which, where, distance = which[order], able[k + where[order]], distance[order]
            for i, a, b in zip(*(x.tolist() for x in np.unique(which, return_index=True)), [*np.flatnonzero(np.diff(which)) + 1, len(which)], strict=False):
                # of these windows, those in which the item's shingles weigh enough are compared shingle by shingle
                inside = np.concatenate([[0.0], np.cumsum(np.where(np.isin(part, self.codes[items[i]]), weights, 0.0))])
                places = where[a:b]
                enough = inside[places + run] - inside[places] >= THRESHOLD * np.maximum(whole[places], self.totals[items[i]]) - 1e-9 * sums[0, -1]
                self._verify(part, first, run, n_words, places[enough], int(items[i]), distance[a:b][enough], found)

    def _verify(self, part, first, run, n_words, where, k, distance, found) -> None:
        for s, d in zip(where.tolist(), distance.tolist(), strict=True):
            if k in found and found[k][0] >= 1.0 and found[k][2] <= first + s:
                continue
            x = similarity(Counter(part[s : s + run].tolist()), self.counts[k], self.weight)
            if x >= THRESHOLD and (k not in found or (-x, first + s) < (-found[k][0], found[k][2])):
                found[k] = (x, d, first + s, n_words)


Block = tuple[list[tuple[int, str]], dict[int, int] | None, int]


_LAST: list = [None, None]


def index_of(block: Block) -> Items:
    """The index of a block; a worker keeps the last one for the tasks that follow."""
    key = (tuple(block[0]), block[2])
    if key != _LAST[0]:
        _LAST[:] = key, Items(*block)
    return _LAST[1]


def leak_column(block: Block, text: Column) -> Column:
    """The leaks of one block of items in each text; null text has none."""

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = index_of(block)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32()), ("word", pa.int32()), ("n_words", pa.int32())]))
        names = ["item_id", "similarity", "distance", "word", "n_words"]
        for batch in batches:
            yield pa.array([[dict(zip(names, r, strict=True)) for r in index.leaks(x.as_buffer().to_pybytes())] if x.is_valid else [] for x in batch], kind)

    return run(text.cast("binary"))


def code_column(text: Column) -> Column:
    """The distinct shingle codes of each item."""

    @arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.unique(c).view(np.int64) if (g := parsed([(0, x)])) and (c := g[0][2]) is not None else [] for x in batch.to_pylist()], pa.list_(pa.int64()))

    return run(text)


def item_blocks(benchmark: DataFrame, most: int = BLOCK_ITEMS, size_of: int = BLOCK_BYTES) -> Iterator[Block]:
    """Benchmark items in blocks of bounded count and size, repeated rows once, all texts of an id in one block, each block
    with the frequencies of its shingles in the whole benchmark. One block is on
    the driver at a time; rows without id or text are left out."""
    sized = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    n, size = sized.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // most), -(-size // size_of))
    if parts == 1:
        yield [(r[0], r[1]) for r in sized.orderBy("item_id", "text").collect()], None, 0
        return
    coded = written(sized.select(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part"), "item_id", "text", code_column(F.col("text")).alias("codes")), "items")
    n_items = coded.where(F.size("codes") > 0).count()
    shingles = coded.select("part", F.explode("codes").alias("code"))
    frequency = written(shingles.join(shingles.groupBy("code").agg(F.count("*").alias("k")), "code").select("part", "code", "k").distinct(), "frequency")
    for k in range(parts):
        items = [(r[0], r[1]) for r in coded.where(F.col("part") == k).select("item_id", "text").orderBy("item_id", "text").collect()]
        yield items, {r[0] % (1 << 64): r[1] for r in frequency.where(F.col("part") == k).select("code", "k").collect()}, n_items


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document row and item that leaks into it: doc_id, item_id, similarity, distance,
    word (first word of the best window) and n_words. Repeated documents each report; an item id
    with several texts reports its best. Empty tables and blank texts give no rows."""
    ship_package(docs.sparkSession)
    out = None
    for block in item_blocks(benchmark, most):
        found = docs.select("doc_id", F.explode(leak_column(block, F.col("text"))).alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_ITEMS) -> DataFrame:
    """Filter: documents that hold a leaked item go; the columns stay as they were."""
    ship_package(docs.sparkSession)
    for block in item_blocks(benchmark, most):
        docs = docs.where(F.size(leak_column(block, F.col("text"))) == 0)
    return docs
