"""Tables from word boxes: tilt, rows, free strips, columns, cells and confidence.

A page is the unit: words are gathered by page once, and from there on every stage is a column of the page's row, so nothing is
shuffled again or written between stages. Tilt, rows, coverage and free strips come from one Arrow function, cells and what scores
count of them from a second one. Both take the pages of a batch at once: their arrays hold the words of all, and pages are told apart by offsets.

words: page, word_no, text, l, t, r, b, conf (null where unknown). Ties of equal row keys go to
the left word, then to word_no.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.chars import TRIM_CHARS, trim
from .shipping import shipped

# The detector's constants.
MIN_CONFIDENCE, NEAR_MISS, MIN_ROWS, MIN_COLUMNS, MAX_COLUMNS = 0.6, 0.35, 2, 2, 12
ROW_TOLERANCE, SEPARATOR, PAD, FREE_SHARE, BIN = 0.6, 0.7, 0.1, 0.25, 0.1
MAX_SLOPE, SLOPE_STEPS, MIN_SLOPE_WORDS = 0.12, 24, 6
WEIGHTS = {"fill": 0.30, "consistency": 0.25, "alignment": 0.20, "columns": 0.15, "depth": 0.10}


def usable(words: DataFrame) -> DataFrame:
    """Words with text and an area."""
    return words.where(_usable(*map(F.col, ("text", *"ltrb"))))


def page_stats(words: DataFrame) -> DataFrame:
    """Per page: n words, h the median height, extent, and mean confidence of the words that have one."""
    return words.groupBy("page").agg(F.count("*").alias("n"), F.median(F.abs(F.col("b") - F.col("t"))).alias("h"), F.min("l").alias("x_min"), F.max("r").alias("x_max"), F.avg("conf").alias("mean_conf"))


#: Pages up to CHAINED words have their rows found word by word side by side; tilts are tried on BLOCK words at once, by counting where a
#: page's buckets are at most SPREAD for each word.
CHAINED, BLOCK, SPREAD = 256, 1024, 16
_TILTS = MAX_SLOPE * np.arange(-SLOPE_STEPS, SLOPE_STEPS + 1) / SLOPE_STEPS
_BELOW_HALF = np.nextafter(0.5, 0.0)


def _buckets(x: np.ndarray, y: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Bucket of each word under each tilt (last axis), halves away from zero."""
    v = _TILTS * x[:, None]
    np.subtract(y[:, None], v, out=v)
    v /= bucket[:, None]
    v += np.copysign(_BELOW_HALF, v)  # as much as lifts a half, and nothing below it, to the next whole number
    return np.trunc(v, out=v)


def _fullest_of(keys: np.ndarray) -> int:
    """Of one page (words x tilts) the step of the tilt with the largest sum of squared bucket counts, the first of equals."""
    scores = [(np.diff(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))) ** 2).sum() for k in np.sort(keys.T, axis=1)]
    return int(np.argmax(scores)) - SLOPE_STEPS


def _fullest(keys: np.ndarray, first: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The same of several pages, that begin at first; page: of each word."""
    ends = keys[:, [0, -1]]  # a word's buckets under all tilts lie between those under the outer ones
    low = np.minimum.reduceat(ends.min(axis=1), first)
    width = np.maximum.reduceat(ends.max(axis=1), first) - low + 1
    narrow = width <= SPREAD * np.diff(np.append(first, len(page)))
    held = np.where(narrow, width, 1.0)
    place, total = held.cumsum() - held, int(held.sum())
    at = keys - (low - place)[page][:, None]
    if not narrow.all():
        at = np.where(narrow[page][:, None], at, place[page][:, None])
    at = at.astype(np.int64)
    at += total * np.arange(len(_TILTS))
    # the sum of squares, as every word counts those of its bucket
    scores = np.add.reduceat(np.bincount(at.ravel())[at], first)
    out = scores.argmax(axis=1) - SLOPE_STEPS
    for k in np.flatnonzero(~narrow):
        out[k] = _fullest_of(keys[page == k])
    return out


def _tilts(x: np.ndarray, y: np.ndarray, first: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step of each page's tilt; pages of few words have none (0)."""
    out, bucket = np.zeros(len(n), int), np.maximum(h * ROW_TOLERANCE, 0.001)
    pages = np.flatnonzero(n >= MIN_SLOPE_WORDS)
    block = n[pages].cumsum() // BLOCK
    for some in np.split(pages, np.flatnonzero(block[1:] != block[:-1]) + 1) if len(pages) else []:
        size = n[some]
        begin, page = size.cumsum() - size, np.repeat(np.arange(len(some)), size)
        at = np.arange(len(page)) + (first[some] - begin)[page]
        out[some] = _fullest(_buckets(x[at], y[at], bucket[some][page]), begin, page)
    return out


def _row_chain(keys: list[float], tolerance: float) -> list[int]:
    """Row of each word, in order: a word joins the row if it is within the tolerance of the row's mean so far."""
    out, row, total, n = [], -1, 0.0, 0
    for key in keys:
        if n and abs(key - total / n) <= tolerance:
            total, n = total + key, n + 1
        else:
            row, total, n = row + 1, key, 1
        out.append(row)
    return out


def _rows(keys: np.ndarray, first: np.ndarray, n: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Rows of the words of many pages, each page's in order: their next words are taken together."""
    out = np.zeros(len(keys), np.int32)
    for k in np.flatnonzero(n > CHAINED):
        out[first[k] : first[k] + n[k]] = _row_chain(keys[first[k] : first[k] + n[k]].tolist(), float(tolerance[k]))
    small = np.flatnonzero(n <= CHAINED)
    small = small[np.argsort(-n[small], kind="stable")]
    total, count, row = np.zeros(len(small)), np.ones(len(small)), np.full(len(small), -1, np.int32)
    for i in range(int(n[small[0]]) if len(small) else 0):
        m = int(np.searchsorted(-n[small], -i))  # pages that have another word
        at = first[small[:m]] + i
        key = keys[at]
        joins = (np.abs(key - total[:m] / count[:m]) <= tolerance[small[:m]]) & (row[:m] >= 0)
        total[:m] = np.where(joins, total[:m] + key, key)
        count[:m] = np.where(joins, count[:m] + 1, 1)
        row[:m] += ~joins
        out[at] = row[:m]
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a place in sorted keys begins a new group."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _coverage(page: np.ndarray, row: np.ndarray, a: np.ndarray, z: np.ndarray, x_min: np.ndarray, bw: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Steps (page, from, to, count): how many merged word intervals, over all rows of a page, cover the bins from to to."""
    at = page * (int(row.max()) + 1) + row
    order = np.lexsort((z, a, at))
    page, at, a, z = page[order], at[order], a[order], z[order]
    new = _starts(at)
    # furthest end so far within a row, by ranks, so that rows cannot mix and no end is rounded
    by_end, rank, group = np.argsort(z, kind="stable"), np.empty(len(z), np.int64), new.cumsum() * len(z)
    rank[by_end] = np.arange(len(z))
    ends = z[by_end[np.maximum.accumulate(group + rank) - group]]
    begins = new.copy()
    begins[1:] |= a[1:] > ends[:-1]
    at = np.flatnonzero(begins)
    page, a, z = page[at], a[at], ends[np.append(at[1:], len(z)) - 1]
    lo = np.maximum(0, np.floor((a - x_min[page]) / bw[page])).astype(np.int64)
    hi = np.minimum(bins[page] - 1, np.floor((z - x_min[page]) / bw[page])).astype(np.int64)
    width = int(bins.max()) + 2
    owner, x, change = np.concatenate((page, page)), np.concatenate((lo, hi + 1)), np.repeat([1, -1], len(page))
    inside = (x < bins[owner]) & (x >= 0)
    places, which = np.unique(owner[inside] * width + x[inside], return_inverse=True)
    upto = np.bincount(which, weights=change[inside], minlength=len(places)).astype(np.int64).cumsum()
    of, start = places // width, places % width
    new = _starts(of)
    before = np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
    count = upto - np.where(before > 0, upto[before - 1], 0)
    last = np.append(new[1:], True)
    return of, start, np.where(last, bins[of], np.append(start[1:], 0)) - 1, count


def _strips(of: np.ndarray, start: np.ndarray, count: np.ndarray, free: np.ndarray, pad: np.ndarray, h: np.ndarray, x_min: np.ndarray, bw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(page, middle) of free strips wide enough to part columns, not at the table's edge."""
    new, empty = _starts(of), count <= free[of]
    begins = empty & (new | ~np.append(False, empty[:-1]))
    first = start[np.maximum.accumulate(np.where(begins, np.arange(len(of)), 0))]
    closes = np.flatnonzero(~empty & ~new & np.append(False, empty[:-1]))
    page, first, lo = of[closes], first[closes], start[closes]
    left, right = x_min[page] + first * bw[page], x_min[page] + lo * bw[page]
    wide = (first > 0) & ((right - left) + pad[page] * 2 >= h[page] * SEPARATOR)
    return page[wide], ((left + right) / 2)[wide]


def _left_first(page: np.ndarray, no: np.ndarray, l: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Words, which come page by page, by keys, the last first, then from the left, then by number."""
    numbered = (no[1:] >= no[:-1]) | (page[1:] != page[:-1])
    return np.lexsort((l, *keys) if numbered.all() else (no, l, *keys))  # the sort is stable


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), values)


def _struct(**fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def _spread(values, at: np.ndarray, n: int, kind: pa.DataType, known: np.ndarray | None = None) -> pa.Array:
    """n values, null but at the places given (of these, but for unknown ones)."""
    out, none = np.zeros(n, kind.to_pandas_dtype()), np.ones(n, bool)
    out[at] = values
    none[at] = False if known is None else ~known
    return pa.array(out, kind, mask=none)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


_BOX = ("word_no", "l", "t", "r", "b", "conf")
LAYOUT = "struct<n:bigint,h:double,x_min:double,x_max:double,mean_conf:double,step:int,slope:double,rows:array<int>,n_rows:int,bw:double,bins:int,free:int,pad:double,steps:array<struct<from:int,to:int,count:int>>,strips:array<double>>"


def _laid(n: np.ndarray, no: np.ndarray, l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, conf: pa.Array) -> SimpleNamespace:
    """Statistics of pages of n words each, that follow one another, and the layout of those with enough words (use): what is told of
    words, steps and strips counts pages within use."""
    many, some = len(n), np.flatnonzero(n)
    first = np.append(0, n.cumsum())[:-1]
    heights = np.abs(b - t)
    heights = heights[np.lexsort((heights, np.repeat(np.arange(many), n)))]
    h, x_min, x_max, mean = (np.zeros(many) for _ in range(4))
    h[some] = heights[first[some] + (n[some] - 1) // 2] * 0.5 + heights[first[some] + n[some] // 2] * 0.5
    known = np.zeros(many, int)
    if len(some):
        x_min[some], x_max[some] = np.minimum.reduceat(l, first[some]), np.maximum.reduceat(r, first[some])
        known[some] = np.add.reduceat(conf.is_valid().to_numpy(zero_copy_only=False).astype(int), first[some])
        mean[some] = np.add.reduceat(conf.fill_null(0.0).to_numpy(), first[some]) / np.maximum(known[some], 1)
    # from here on pages with enough words
    use = np.flatnonzero((n >= MIN_ROWS * MIN_COLUMNS) & (h > 0))
    mine = np.repeat(np.isin(np.arange(many), use), n)
    no, l, t, r, b = (x[mine] for x in (no, l, t, r, b))
    size, hh, lo = n[use], h[use], x_min[use]
    first, page = np.append(0, size.cumsum())[:-1], np.repeat(np.arange(len(use)), size)
    x, y = (l + r) / 2, (t + b) / 2
    step = _tilts(x, y, first, size, hh)
    tilted = size >= MIN_SLOPE_WORDS
    slope = np.where(tilted, MAX_SLOPE * step / SLOPE_STEPS, 0.0)
    keys = y - slope[page] * x
    order = _left_first(page, no, l, keys, page)
    rows = np.zeros(len(keys), np.int32)
    rows[order] = ranked = _rows(keys[order], first, size, hh * ROW_TOLERANCE)
    n_rows, pad = ranked[first + size - 1] + 1, hh * PAD
    bw = np.maximum(np.maximum(hh * BIN, (x_max[use] - lo) / 4000), 0.001)
    bins, free = np.maximum(1, np.floor((x_max[use] - lo) / bw) + 1).astype(np.int64), np.floor(n_rows * FREE_SHARE).astype(int)
    if len(use):
        of, start, end, count = _coverage(page, rows, l - pad[page], r + pad[page], lo, bw, bins)
        owner, strips = _strips(of, start, count, free, pad, hh, lo, bw)
    else:
        of = start = end = count = owner = np.zeros(0, int)
        strips = np.zeros(0)
    return SimpleNamespace(
        many=many, some=some, use=use, mine=mine, page=page, h=h, x_min=x_min, x_max=x_max, known=known, mean=mean, step=step, tilted=tilted, slope=slope, rows=rows, n_rows=n_rows,
        pad=pad, bw=bw, bins=bins, free=free, of=of, start=start, end=end, count=count, owner=owner, strips=strips,
    )


def _layout(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for number, lefts, tops, rights, bottoms, confs in batches:
        n = np.diff(lefts.offsets.to_numpy())
        x = _laid(n, *map(_flat, (number, lefts, tops, rights, bottoms)), confs.flatten())
        use, many, some = x.use, x.many, x.some
        deal = lambda pages: np.bincount(use[pages], minlength=many)
        steps = _struct(**{"from": pa.array(x.start, pa.int32()), "to": pa.array(x.end, pa.int32()), "count": pa.array(x.count, pa.int32())})
        whole, real = (lambda v, known=None: _spread(v, use, many, pa.int32(), known)), (lambda v, known=None: _spread(v, use, many, pa.float64(), known))
        stat = lambda v, known=None: _spread(v[some], some, many, pa.float64(), known)
        yield _struct(
            n=pa.array(n, pa.int64()), h=stat(x.h), x_min=stat(x.x_min), x_max=stat(x.x_max), mean_conf=stat(x.mean, x.known[some] > 0), step=whole(x.step, x.tilted), slope=real(x.slope, x.tilted),
            rows=_listed(deal(x.page), pa.array(x.rows, pa.int32())), n_rows=whole(x.n_rows), bw=real(x.bw), bins=whole(x.bins), free=whole(x.free), pad=real(x.pad), steps=_listed(deal(x.of), steps), strips=_listed(deal(x.owner), pa.array(x.strips)),
        )


def _usable(text: Column, l: Column, t: Column, r: Column, b: Column) -> Column:
    return (trim(text) != "") & (r != l) & (b != t)


def laid_out(words: DataFrame) -> DataFrame:
    """One row per page, those without a usable word too: words (the usable ones as an array), the statistics of page_stats() and, if
    they suffice for a table, step and slope (the tilt whose horizontal buckets are fullest; of equals the most negative; null for few words),
    rows (of each word, from 0), n_rows (null where they do not suffice), the bins of coverage (bw, bins, free, pad), its steps, and strips, the middles of free strips."""
    use = _usable(*map(F.col, ("text", *"ltrb")))
    return _with_layout(words.groupBy("page").agg(F.collect_list(F.when(use, F.struct("word_no", "text", "l", "t", "r", "b", "conf"))).alias("words")))


def _with_layout(pages: DataFrame) -> DataFrame:
    pages = shipped(pages)
    # not deterministic by name only: a filter on what it gives must not compute it again
    found = arrow_udf(_layout, LAYOUT).asNondeterministic()(*[F.col("words")[c] for c in _BOX])
    return pages.withColumn("_", found).select(*pages.columns, "_.*")


def _accepted(x: Column) -> Column:
    """Whether a vertical line falls on a free bin inside the extent of its page."""
    at = F.floor((x - F.col("x_min")) / F.col("bw"))
    return (x > F.col("x_min")) & (x < F.col("x_max")) & F.exists("steps", lambda s: (at >= s["from"]) & (at <= s["to"]) & (s["count"] <= F.col("free")))


def ruled(pages: DataFrame, grid: DataFrame, how: str = "inner") -> DataFrame:
    """Adds to laid-out pages (lines, n_vertical, n_horizontal): the vertical ruling lines that fall on free bins inside the
    extent, in order; pages with fewer than two vertical lines have none. grid: page, vertical, horizontal (arrays), one row a page."""
    met = pages.join(grid.select("page", "vertical", "horizontal"), "page", how)
    lines = F.when(F.col("n_rows").isNotNull() & (F.size("vertical") >= 2), F.array_sort(F.filter("vertical", _accepted)))
    return met.select(*pages.columns, lines.alias("lines"), F.size("vertical").alias("n_vertical"), F.size("horizontal").alias("n_horizontal"))


def columns(pages: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Pages with their column edges (n_cols is null where there is no layout), from accepted ruling lines if any, else from free strips, and the
    share of ruling evidence (null without)."""
    out = pages
    if grid is None:
        out = out.withColumn("line_score", F.lit(None).cast("double"))
        inner = F.col("strips")
    else:
        out = ruled(out, grid, "left")
        clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        fit = F.when(F.col("n_vertical") > 0, clamp(F.size("lines") / F.col("n_vertical"))).otherwise(0.0)
        rows = F.when(F.col("n_horizontal") > 0, clamp(F.col("n_horizontal") / (F.col("n_rows") + 1))).otherwise(0.0)
        out = out.withColumn("line_score", F.when(F.size("lines") >= 1, fit * 0.6 + rows * 0.4))
        inner = F.coalesce(F.when(F.size("lines") >= MIN_COLUMNS - 1, F.col("lines")), F.col("strips"))
    return out.withColumn("edges", F.concat(F.array(F.col("x_min") - 1), inner, F.array(F.col("x_max") + 1))).withColumn("n_cols", F.when(F.col("n_rows").isNotNull(), F.size("edges") - 1))


_CELL = "struct<row:int,col:int,text:string,l:double,t:double,r:double,b:double>"
_COUNTS = "filled:bigint,consistent:bigint,first_filled:bigint,first_digit:boolean,body_digit:boolean,alignment:double,used:bigint"


def _columns_of(page: np.ndarray, l: np.ndarray, r: np.ndarray, edges: np.ndarray, first: np.ndarray, n_cols: np.ndarray) -> np.ndarray:
    """The column that a segment overlaps most, the first of equals."""
    best, col = np.full(len(page), -np.inf), np.zeros(len(page), int)
    for c in range(int(n_cols.max())):
        at = np.flatnonzero(c < n_cols[page])
        edge = first[page[at]] + c
        more = np.minimum(r[at], edges[edge + 1]) - np.maximum(l[at], edges[edge])
        win = more > best[at]
        best[at[win]], col[at[win]] = more[win], c
    return col


def _filled(page: np.ndarray, no: np.ndarray, row: np.ndarray, l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, h: np.ndarray, edges: np.ndarray, n_cols: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Filled cells (page, row, col, l, t, r, b) in order, the words in the order of their cells, and where each cell's begin and end. Words with
    narrow gaps form a segment; a segment goes to the column it overlaps most."""
    order = _left_first(page, no, l, page * (int(row.max()) + 1) + row)
    page, row, l, t, r, b = (x[order] for x in (page, row, l, t, r, b))
    new = _starts(page, row)
    new[1:] |= ~(l[1:] - r[:-1] < h[page[1:]] * SEPARATOR)
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(page)))
    page, row, l, t, r, b = page[at], row[at], np.minimum.reduceat(l, at), np.minimum.reduceat(t, at), np.maximum.reduceat(r, at), np.maximum.reduceat(b, at)
    col = _columns_of(page, l, r, edges, np.append(0, (n_cols + 1).cumsum())[:-1], n_cols)
    # segments of a row come from left to right
    seg = np.argsort((page * (int(row.max()) + 1) + row) * (int(col.max()) + 1) + col, kind="stable")
    page, row, col, l, t, r, b = (x[seg] for x in (page, row, col, l, t, r, b))
    # words in the order of their segments
    ends = sizes[seg].cumsum()
    word = np.arange(len(order)) + np.repeat(at[seg] - (ends - sizes[seg]), sizes[seg])
    cell = np.flatnonzero(_starts(page, row, col))
    held = np.append(np.append(0, ends)[cell], len(order))
    boxes = np.minimum.reduceat(l, cell), np.minimum.reduceat(t, cell), np.maximum.reduceat(r, cell), np.maximum.reduceat(b, cell)
    return (page[cell], row[cell], col[cell], *boxes), order[word], held


def _cells(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Of pages with an allowed number of columns (null edges: none) all cells, row by row, texts of empty ones null, and what
    scores count."""
    for number, texts, lefts, tops, rights, bottoms, rowed, edged, heights, depths in batches:
        valid, n = edged.is_valid().to_numpy(zero_copy_only=False), np.diff(lefts.offsets.to_numpy())
        many, use = len(n), np.flatnonzero(valid)
        if not len(use):
            yield pa.nulls(many, pa.struct([("cells", pa.list_(_cell_type())), *_count_types()]))
            continue
        mine = np.flatnonzero(np.repeat(valid, n))
        no, l, t, r, b = (_flat(x)[mine] for x in (number, lefts, tops, rights, bottoms))
        row = _flat(rowed.filter(edged.is_valid()))
        h, depth = heights.to_numpy(zero_copy_only=False)[use], depths.to_numpy(zero_copy_only=False)[use].astype(int)
        kept = edged.drop_null()
        edges, n_cols = _flat(kept), np.diff(kept.offsets.to_numpy()) - 1
        (page, row, col, l, t, r, b), word, held = _filled(np.repeat(np.arange(len(use)), n[use]), no, row, l, t, r, b, h, edges, n_cols)
        trimmed = pc.utf8_trim(texts.flatten().take(pa.array(mine[word])), characters=TRIM_CHARS)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(held, pa.int32()), trimmed), " ")
        area = depth * n_cols
        place = np.append(0, area.cumsum())[:-1][page] + row * n_cols[page] + col
        total, owner = int(area.sum()), np.repeat(np.arange(len(use)), area)
        k = np.arange(total) - np.append(0, area.cumsum())[:-1][owner]
        at_cell = np.full(total, -1)
        at_cell[place] = np.arange(len(place))
        box = lambda v: pa.array(np.where(at_cell < 0, 0.0, v[at_cell]))
        full = _struct(row=pa.array(k // n_cols[owner], pa.int32()), col=pa.array(k % n_cols[owner], pa.int32()), text=text.take(pa.array(at_cell, mask=at_cell < 0)), l=box(l), t=box(t), r=box(r), b=box(b))
        sized = np.zeros(many, int)
        sized[use] = area
        counts = _counts(use, many, page, row, col, l, h, depth) | _header_counts(use, many, page, row, pc.match_substring_regex(text, "[0-9]").to_numpy(zero_copy_only=False))
        yield _struct(cells=_listed(sized, full), **{c: counts[c] for c, _ in _count_types()})


def _counts(use: np.ndarray, many: int, page: np.ndarray, row: np.ndarray, col: np.ndarray, l: np.ndarray, h: np.ndarray, depth: np.ndarray) -> dict[str, pa.Array]:
    """What scores count of filled cells, which come by page, row and column."""
    pages = len(use)
    at = np.flatnonzero(_starts(page, row))
    of, k = page[at], np.diff(np.append(at, len(page)))
    # left edges by column, at most one in a row
    order = np.lexsort((col, page))
    at = np.flatnonzero(_starts(page[order], col[order]))
    owner, size = page[order][at], np.diff(np.append(at, len(page)))
    fit = np.maximum(0.0, 1.0 - (np.maximum.reduceat(l[order], at) - np.minimum.reduceat(l[order], at)) / h[owner] / 3.0)
    paired = np.bincount(owner[size >= 2], minlength=pages)
    alignment = np.bincount(owner[size >= 2], weights=fit[size >= 2], minlength=pages) / np.maximum(paired, 1)
    used = np.bincount(owner[size >= np.maximum(2, np.ceil(depth * 0.6))[owner]], minlength=pages)
    count = lambda v: _spread(v, use, many, pa.int64())
    return {"filled": count(np.bincount(page, minlength=pages)), "consistent": count(np.bincount(of[k >= MIN_COLUMNS], minlength=pages)), "alignment": _spread(alignment, use, many, pa.float64()), "used": count(used)}


def _header_counts(use: np.ndarray, many: int, page: np.ndarray, row: np.ndarray, digit: np.ndarray) -> dict[str, pa.Array]:
    """What the header rule counts of the same cells."""
    pages = len(use)
    at = np.flatnonzero(_starts(page, row))
    of, k, digits, top = page[at], np.diff(np.append(at, len(page))), np.logical_or.reduceat(digit, at), row[at] == 0
    first, first_digit, begun = np.zeros(pages, int), np.zeros(pages, bool), np.zeros(pages, bool)
    first[of[top]], first_digit[of[top]], begun[of[top]] = k[top], digits[top], True
    flag = lambda v, known=None: _spread(v, use, many, pa.bool_(), known)
    return {"first_filled": _spread(first, use, many, pa.int64(), begun), "first_digit": flag(first_digit, begun), "body_digit": flag(np.bincount(of[~top & digits], minlength=pages) > 0)}


_OUTCOME = "struct<n:bigint,h:double,mean_conf:double,n_rows:int,n_cols:int,filled:bigint,consistent:bigint,alignment:double,used:bigint>"


def _outcome(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """What decides on tables of pages without ruling lines: layout, and what scores count of the cells between free strips. Texts are only asked whether they are blank."""
    for texts, number, lefts, tops, rights, bottoms, confs in batches:
        no, l, t, r, b = map(_flat, (number, lefts, tops, rights, bottoms))
        said = pc.binary_length(pc.utf8_trim(texts.flatten(), characters=TRIM_CHARS)).fill_null(0).to_numpy(zero_copy_only=False) > 0
        good = said & (r != l) & (b != t)
        n = np.diff(np.append(0, good.cumsum())[lefts.offsets.to_numpy() - lefts.offsets[0].as_py()])
        no, l, t, r, b = (v[good] for v in (no, l, t, r, b))
        x = _laid(n, no, l, t, r, b, confs.flatten().filter(pa.array(good)))
        n_cols = np.bincount(x.owner, minlength=len(x.use)) + 1
        fit = (n_cols >= MIN_COLUMNS) & (n_cols <= MAX_COLUMNS)
        use, cols, mine, which = x.use[fit], n_cols[fit], fit[x.page], fit.cumsum() - 1
        last = (cols + 1).cumsum() - 1
        edges = np.zeros(int(last[-1]) + 1 if len(use) else 0)
        inner = np.ones(len(edges), bool)
        inner[last] = inner[last - cols] = False
        edges[last], edges[last - cols], edges[inner] = x.x_max[use] + 1, x.x_min[use] - 1, x.strips[fit[x.owner]]
        counts = {c: pa.nulls(x.many, kind) for c, kind in _count_types()}
        if len(use):
            no, l, t, r, b = (v[x.mine][mine] for v in (no, l, t, r, b))
            (page, row, col, left, *_), _, _ = _filled(which[x.page[mine]], no, x.rows[mine], l, t, r, b, x.h[use], edges, cols)
            counts = _counts(use, x.many, page, row, col, left, x.h[use], x.n_rows[fit])
        yield _struct(
            n=pa.array(n, pa.int64()), h=_spread(x.h[x.some], x.some, x.many, pa.float64()), mean_conf=_spread(x.mean[x.some], x.some, x.many, pa.float64(), x.known[x.some] > 0),
            n_rows=_spread(x.n_rows, x.use, x.many, pa.int32()), n_cols=_spread(n_cols, x.use, x.many, pa.int32()), **{c: counts[c] for c in ("filled", "consistent", "alignment", "used")},
        )


def _cell_type() -> pa.DataType:
    return pa.struct([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), *[(c, pa.float64()) for c in "ltrb"]])


def _count_types() -> list[tuple[str, pa.DataType]]:
    return [*[(c, pa.int64()) for c in ("filled", "consistent", "first_filled")], ("first_digit", pa.bool_()), ("body_digit", pa.bool_()), ("alignment", pa.float64()), ("used", pa.int64())]


def _scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """What scores count, without the cells."""
    for found in _cells(batches):
        kinds = _count_types()
        yield _struct(**{c: pc.struct_field(found, c).cast(kind) for c, kind in kinds})


def celled(cols: DataFrame, keep: bool = True) -> DataFrame:
    """Adds to pages what scores count of their cells, and on demand the cells of the whole grid (row, col, text, l, t, r, b; text null where
    empty); null where the number of columns is not allowed."""
    inside = (F.col("n_cols") >= MIN_COLUMNS) & (F.col("n_cols") <= MAX_COLUMNS)
    kind = f"struct<cells:array<{_CELL}>,{_COUNTS}>" if keep else f"struct<{_COUNTS}>"
    of = arrow_udf(_cells if keep else _scored, kind).asNondeterministic()
    found = of(*[F.col("words")[c] for c in ("word_no", "text", "l", "t", "r", "b")], "rows", F.when(inside, F.col("edges")), "h", "n_rows")
    return cols.withColumn("_", found).select(*[c for c in cols.columns if c not in ("words", "rows", "steps")], "_.*")


def _confidence() -> Column:
    """How sure a table is, from what scores count."""
    n, m = F.col("n_rows"), F.col("n_cols")
    score = (
        F.col("filled") / (n * m) * WEIGHTS["fill"] + F.col("consistent") / n * WEIGHTS["consistency"] + F.col("alignment") * WEIGHTS["alignment"]
        + F.col("used") / m * WEIGHTS["columns"] + F.least(F.lit(1.0), (n - 1) / F.lit(3.0)) * WEIGHTS["depth"]
    )
    score = F.when(F.col("line_score").isNotNull(), score + (1 - score) * F.col("line_score") * 0.5).otherwise(score)
    trust = F.least(F.greatest(F.col("mean_conf"), F.lit(0.0)), F.lit(1.0))
    score = score * F.when(F.col("mean_conf").isNull(), 1.0).otherwise(0.85 + trust * 0.15)
    return F.when(F.col("filled").isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def scored(found: DataFrame) -> DataFrame:
    """Adds confidence and the header rule to pages with their counts."""
    n, m = F.col("n_rows"), F.col("n_cols")
    header = (n >= 2) & (F.col("first_filled") == m) & ~F.col("first_digit") & F.col("body_digit")
    return found.withColumns({"confidence": _confidence(), "header": header})


def judged(found: DataFrame) -> DataFrame:
    """Adds the reason why there is no table (null if there is) and near_miss to pages with their confidence."""
    few = F.coalesce(F.col("n"), F.lit(0)) < MIN_ROWS * MIN_COLUMNS
    reason = (
        F.when(few | F.coalesce(F.col("h") <= 0, F.lit(False)), "tooFewWords").when(F.col("n_rows") < MIN_ROWS, "tooFewRows").when(F.col("n_cols") < MIN_COLUMNS, "tooFewColumns")
        .when(F.col("n_cols") > MAX_COLUMNS, "tooManyColumns").when(F.col("confidence") < MIN_CONFIDENCE, "lowConfidence")
    )
    near = F.coalesce((F.col("reason") == "lowConfidence") & (F.col("confidence") >= NEAR_MISS), F.lit(False))
    return found.withColumns({"few": few, "reason": reason}).withColumn("near_miss", near)


def outcomes(pages: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Adds near_miss and has_table to pages whose words are an array, of (word_no, text, l, t, r, b, conf). Both depend on where words are and whether they say
    anything, not on what they say; so without ruling lines one pass is enough."""
    if grid is None:
        met = shipped(pages)
        found = arrow_udf(_outcome, _OUTCOME).asNondeterministic()(*[F.col("words")[c] for c in ("text", *_BOX)])
        met = met.withColumn("_", found).select(*pages.columns, "_.*", F.lit(None).cast("double").alias("line_score")).withColumn("confidence", _confidence())
    else:
        met = pages.withColumn("words", F.filter("words", lambda w: _usable(*[w[c] for c in ("text", *"ltrb")])))
        met = scored(celled(columns(_with_layout(met), grid), False))
    kept = [c for c in pages.columns if c != "words"]
    return judged(met).select(*kept, "near_miss", F.col("reason").isNull().alias("has_table"))


class Analysis:
    """All stages over one table of words; each attribute is a DataFrame, made when first asked for."""

    def __init__(self, words: DataFrame, grid: DataFrame | None = None) -> None:
        self.words, self.grid = words, grid

    @cached_property
    def pages(self) -> DataFrame:
        return laid_out(self.words)

    @property
    def laid(self) -> DataFrame:
        """Pages with enough words for a table."""
        return self.pages.where("n_rows is not null")

    @property
    def slopes(self) -> DataFrame:
        return self.laid.where("step is not null").select("page", "step", "slope")

    @property
    def rows(self) -> DataFrame:
        return self.laid.select("page", F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("words").alias("word")))).select("page", "row", "word.*")

    @property
    def steps(self) -> DataFrame:
        return self.laid.select("page", F.inline("steps"))

    @property
    def separators(self) -> DataFrame:
        return self.laid.select("page", F.explode("strips").alias("x"))

    @property
    def cells(self) -> DataFrame:
        """Filled cells (page, row, col, text, l, t, r, b)."""
        return self._decided(True).select("page", F.inline("cells")).where("text is not null")

    def _decided(self, keep: bool) -> DataFrame:
        """Pages with n_rows, n_cols, confidence, header and the reason why there is no table (null if there is)."""
        return judged(scored(celled(columns(self.pages, self.grid), keep)))

    def decisions(self) -> DataFrame:
        """Per page: rows, columns, confidence, why there is no table (null if there is), near miss and header."""
        return self._decided(False).select(
            "page", "n_rows", "n_cols", F.when(~F.col("few") & (F.col("n_rows") >= MIN_ROWS), F.col("confidence")).alias("confidence"), "reason",
            "near_miss", F.when(F.col("reason").isNull(), F.col("header")).alias("has_header"),
        )

    def table_cells(self) -> DataFrame:
        """Every cell of every accepted table, empty ones with '' and zero boxes."""
        full = self._decided(True).where("reason is null").select("page", F.col("header").alias("has_header"), F.inline("cells"))
        return full.select("page", "row", "col", "has_header", F.coalesce("text", F.lit("")).alias("text"), *"ltrb")


def aligned_text(table_cells: DataFrame) -> DataFrame:
    """(page, text): cells padded to their column's width, two spaces apart."""
    width = F.max(F.length(trim(F.col("text")))).over(W.partitionBy("page", "col"))
    last = F.max("col").over(W.partitionBy("page"))
    padded = table_cells.select("page", "row", "col", F.when(F.col("col") == last, trim(F.col("text"))).otherwise(F.rpad(trim(F.col("text")), width, " ")).alias("cell"))
    ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]])
    lines = padded.groupBy("page", "row").agg(F.rtrim(F.array_join(ordered("col", "cell"), "  ")).alias("line"))
    return lines.groupBy("page").agg(F.array_join(ordered("row", "line"), "\n").alias("text"))


def update_cell(table_cells: DataFrame, row: int, col: int, text: str) -> DataFrame:
    """Every table with one cell's text replaced; tables without that cell stay as they are."""
    return table_cells.withColumn("text", F.when((F.col("row") == row) & (F.col("col") == col), F.lit(text)).otherwise(F.col("text")))


def shape(table_cells: DataFrame) -> DataFrame:
    """Per table: rows, columns, filled cells, header and first body row as arrays of texts."""
    text = lambda row: F.transform(F.array_sort(F.collect_list(F.when(F.col("row") == row, F.struct("col", "text")))), lambda x: x["text"])
    out = table_cells.groupBy("page").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count(F.when(trim(F.col("text")) != "", 1)).alias("filled"), F.first("has_header").alias("h"), text(0).alias("r0"), text(1).alias("r1"))
    return out.select("page", "rows", "cols", "filled", F.when(F.col("h"), F.col("r0")).alias("header"), F.when(F.col("h"), F.col("r1")).otherwise(F.col("r0")).alias("body"))
