"""Page numbers of planned lines: a page takes lines while they fit, then the next one starts.

Where a page ends depends on where the one before it ended, so a document is a chain. It is cut into chunks of
lines all the same: for every height that a page may already have used when a chunk begins, a chunk's table tells what is used
when it ends and how many pages it has begun. Tables of one document are then followed from chunk to chunk (a table is
some 1,400 numbers for 1,024 lines), and with its own beginning known each chunk is numbered by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pdfplan import A4_H
from .shipping import shipped

# Margins of two centimetres, the footer's and the header's heights, the most pages of a document.
MARGIN, FOOTER, HEADER, MAX_PAGES = 56.692913385827, 17.0, 28, 500
ROOM = int(A4_H - 2 * MARGIN - FOOTER)
CHUNK = 1024
#: Tables that a Python worker holds at once.
TABLES = 256


def page_starts(heights: np.ndarray, used: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pages that have used some of their room: (which of them, the line before which the next page starts), again and
    again while any starts one."""
    upto = heights.cumsum()
    at = np.searchsorted(upto, room - used, side="right")
    which = np.flatnonzero(at < len(upto))
    at = at[which]
    while len(which):
        yield which, at
        at = np.searchsorted(upto, upto[at] - heights[at] + room, side="right")
        more = at < len(upto)
        which, at = which[more], at[more]


def chunk_table(heights: np.ndarray, room: int = ROOM) -> np.ndarray:
    """What is used behind the lines, then how many pages they begin, for every whole height used before them."""
    used = np.arange(room + 1)
    last, pages = np.full(room + 1, -1), np.zeros(room + 1, int)
    for which, at in page_starts(heights, used, room):
        last[which] = at
        pages[which] += 1
    upto = np.append(0, heights.cumsum())
    return np.append(np.where(last < 0, used + upto[-1], upto[-1] - upto[np.maximum(last, 0)]), pages).astype(np.int32)


def chunk_pages(heights: np.ndarray, used: int, page: int, room: int = ROOM) -> np.ndarray:
    """Page of each line, for the page and the height used before the first one."""
    begun = np.zeros(len(heights), int)
    for _, at in page_starts(heights, np.array([used]), room):
        begun[at] += 1
    return page + begun.cumsum()


def followed(tables: Column, start: Column) -> Column:
    """(used height, page) behind each of a document's tables, from page 1 on. Tables stay in the JVM: of each, two numbers are looked up."""
    half = (F.size(F.get(tables, F.lit(0))) / 2).cast("int")
    first = F.struct(start.cast("int").alias("used"), F.lit(1).alias("page"), F.array().cast("array<array<int>>").alias("ends"))

    def step(so_far: Column, table: Column) -> Column:
        used, page = F.get(table, so_far["used"]), so_far["page"] + F.get(table, half + so_far["used"])
        return F.struct(used.alias("used"), page.alias("page"), F.array_append(so_far["ends"], F.array(used, page)).alias("ends"))

    return F.aggregate(tables, first, step, lambda so_far: so_far["ends"])


def paginate(plan: DataFrame, key: str, title: Column | None = None, room: int = ROOM, chunk: int = CHUNK) -> DataFrame:
    """Adds page, from 1, to a plan (key, line, height): lines of a key count from 0 without gaps, heights are whole points.

    The first page's header takes its part of the room where the title is not blank (title: a column of the plan, the same on all
    lines of a key; none: no header). Null heights take no room; a line higher than a page has one of its own. Repeated lines are numbered
    alike (the last height counts) and a null key is a key. An empty plan stays empty.
    """
    at, lines = F.col("line"), shipped(plan).withColumn("_title", F.lit(None).cast("string") if title is None else title)
    height = F.least(F.coalesce(F.col("height"), F.lit(0)).cast("int"), F.lit(room))
    once = lines.groupBy(key, "line").agg(F.max(height).alias("height"), F.max(F.trim("_title") != "").alias("titled"))
    held = F.transform(F.sort_array(F.collect_list(F.struct("line", "height"))), lambda x: x["height"])
    start = F.when(F.max("titled"), F.lit(HEADER)).otherwise(0)
    chunks = once.groupBy(F.col(key).alias("_key"), F.floor(at / chunk).alias("_chunk")).agg(held.alias("heights"), start.alias("start"))

    @F.pandas_udf("array<int>")
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for heights in batches:
            for k in range(0, len(heights), TABLES):
                yield pd.Series([chunk_table(np.asarray(h), room) for h in heights[k : k + TABLES]])

    @F.pandas_udf("array<int>")
    def numbers(heights: pd.Series, used: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([chunk_pages(np.asarray(h), int(u), int(p), room) for h, u, p in zip(heights, used, page, strict=True)])

    # only chunks that another one may follow need a table, so short documents take no part here
    full = chunks.where(F.size("heights") == chunk).select("_key", "_chunk", "start", table("heights").alias("table"))
    chains = full.groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "table"))), lambda x: x["table"]).alias("tables"), F.max("start").alias("start"))
    ends = chains.select(F.col("_key").alias("_k"), F.posexplode(followed(F.col("tables"), F.col("start"))).alias("n", "end")).select("_k", (F.col("n") + 1).cast("bigint").alias("_c"), F.get("end", F.lit(0)).alias("used"), F.get("end", F.lit(1)).alias("page"))
    begun = chunks.join(ends, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    numbered = begun.select("_key", "_chunk", F.posexplode(numbers("heights", F.coalesce("used", "start"), F.coalesce("page", F.lit(1)))).alias("n", "page"))
    pages = numbered.select("_key", (F.col("_chunk") * chunk + F.col("n")).alias("_line"), "page")
    return plan.join(pages, plan[key].eqNullSafe(F.col("_key")) & (at == F.col("_line"))).select(*[plan[c] for c in plan.columns], "page")


def page_counts(paged: DataFrame, key: str, most: int = MAX_PAGES) -> DataFrame:
    """(key, n_pages, exportable): documents of more pages than the most are not exported."""
    return paged.groupBy(key).agg(F.max("page").cast("bigint").alias("n_pages")).withColumn("exportable", F.col("n_pages") <= most)
