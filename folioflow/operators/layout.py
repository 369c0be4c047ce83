"""Layout text from lines in blocks, and documents from sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.chars import TRIM_CHARS
from ..functions.text import join_sections, normalize_layout
from .shipping import shipped

# The gap that starts a paragraph, and the text of an empty section.
PARAGRAPH_GAP = 0.8
EMPTY_SECTION = "(Bu bölümde metin bulunamadı)"


def _sorted(texts: pa.Array, *keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The order of lines by page and keys, nulls first, then text, and where another of the first two of these keys begins."""
    parts = [x for key in keys for x in (key.is_valid().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(zero_copy_only=False))]
    order = np.lexsort(parts[::-1])
    other = np.ones((2, len(order)), bool)
    for which, some in ((0, parts[:4]), (1, parts)):
        other[which, 1:] = np.any([p[order[1:]] != p[order[:-1]] for p in some], axis=0)
    if len(order) and not other[1].all():  # lines of one number go by their texts
        rank = np.empty(len(order), np.int64)
        rank[pc.sort_indices(texts, null_placement="at_start").to_numpy()] = np.arange(len(order))
        order = np.lexsort([rank, *parts[::-1]])
    return order, other[0]


def _joined(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Lines of pages as texts: blocks without text are left out, a block begins a paragraph if its gap to the block before is wide against that
    block's mean line height, blank lines included."""
    for texts, blocks, numbers, tops, bottoms in batches:
        n = np.diff(blocks.offsets.to_numpy())
        page = np.repeat(np.arange(len(n)), n)
        clean = pc.utf8_trim(texts.flatten(), characters=TRIM_CHARS)
        order, new = _sorted(clean, pa.array(page), blocks.flatten(), numbers.flatten())
        page, clean, first = page[order], clean.take(pa.array(order)), np.flatnonzero(new)
        if not len(first):
            yield pa.array([""] * len(n), pa.string())
            continue
        top, bottom = (x.flatten().to_numpy(zero_copy_only=False).astype(float)[order] for x in (tops, bottoms))
        known_top, known_bottom = (x.flatten().is_valid().to_numpy(zero_copy_only=False)[order] for x in (tops, bottoms))
        both, some = known_top & known_bottom, lambda x: np.add.reduceat(x.astype(int), first)
        lines = some(both)
        height = np.add.reduceat(np.where(both, np.abs(bottom - top), 0.0), first) / np.maximum(lines, 1)
        height = np.where(lines > 0, np.maximum(height, 1.0), 1.0)
        upper, lower = np.fmin.reduceat(np.where(known_top, top, np.nan), first), np.maximum.reduceat(np.where(known_bottom, bottom, -np.inf), first)
        # blocks with text, and their texts
        said = pc.binary_length(clean).fill_null(0).to_numpy(zero_copy_only=False) > 0
        full = np.flatnonzero(some(said))
        text = pc.binary_join(_listed(some(said)[full], clean.filter(pa.array(said))), "\n")
        of = page[first][full]
        before = full[np.maximum(np.arange(len(full)) - 1, 0)]
        gap, limit = upper[full] - lower[before], height[before] * PARAGRAPH_GAP
        follows = np.append(False, of[1:] == of[:-1])[: len(of)] & (some(known_top)[full] > 0) & (some(known_bottom)[before] > 0)
        wide = (gap > limit) | (np.isnan(gap) & ~np.isnan(limit))  # what is no number counts as large, as elsewhere
        between = pa.array(["", "\n", "\n\n"]).take(pa.array(np.where(follows, 1 + wide, 0)))
        yield pc.binary_join(_listed(np.bincount(of, minlength=len(n)), pc.binary_join_element_wise(between, text, "")), "")


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), values)


def with_page_text(pages: DataFrame, lines: Column, text: Column, name: str = "text") -> DataFrame:
    """Adds the text of pages, from the array of their lines (block, line, top, bottom, in any order) and that of these lines' texts."""
    pages = shipped(pages)
    found = arrow_udf(_joined, "string")(text, *[lines[c] for c in ("block", "line", "top", "bottom")])
    return pages.withColumn(name, normalize_layout(found))


def format_blocks(lines: DataFrame) -> DataFrame:
    """Page text from lines (page, block, line, text, top, bottom): one row (page, text) per page. A page is one group, as is the result."""
    pages = lines.groupBy("page").agg(F.collect_list(F.struct("block", "line", "text", "top", "bottom")).alias("lines"))
    return with_page_text(pages, F.col("lines"), F.col("lines")["text"]).select("page", "text")


def sections_of(order: str, text: Column) -> Column:
    """A group's sections as an array, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("text")))), lambda x: x["text"])


def merge_sections(units: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """One text per document from its units (key, order, text)."""
    grouped = units.groupBy(key).agg(sections_of(order, F.coalesce("text", F.lit(""))).alias("sections"))
    return grouped.select(key, join_sections(F.col("sections"), label, EMPTY_SECTION).alias("text"), F.size("sections").cast("bigint").alias("units"))
