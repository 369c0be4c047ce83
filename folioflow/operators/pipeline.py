"""Recognised pages to repaired text and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chars import is_blank
from .layout import with_page_text
from .normalize import repaired
from .tables import outcomes


def process(lines: DataFrame, words: DataFrame, raw: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """One row per page of raw (page, raw_text, conf): text, n_changes, near_miss, has_table.

    lines: page, block, line, text, top, bottom, conf. words: as the detector takes them, with conf already
    the line's where a word has none. Lines and words are gathered by page, then process_pages() does the work.
    """
    gathered = lambda df, name, *c: df.groupBy("page").agg(F.collect_list(F.struct(*c)).alias(name))
    held = gathered(lines, "lines", "block", "line", "text", "top", "bottom", "conf")
    boxes = gathered(words, "words", "word_no", "text", "l", "t", "r", "b", "conf")
    return process_pages(raw.join(held, "page", "left").join(boxes, "page", "left"), grid)


def process_pages(pages: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """The same for pages that hold their lines and words as arrays: page, raw_text, conf, lines (block, line, text, top, bottom, conf), words
    (word_no, text, l, t, r, b, conf). A page is a row throughout, so nothing is shuffled or written between.

    Changes of lines count. A page without lines has its raw text repaired, under the page's confidence. Words
    are not repaired: that leaves blank ones blank and others not, which is all that near_miss and has_table take from their texts.
    """
    fixed = pages.withColumn("fixed", F.transform("lines", lambda x: repaired(x["text"], x["conf"])))
    counts = F.filter(F.col("fixed")["n"], lambda n: n.isNotNull())
    changed = F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n))
    met = with_page_text(fixed.withColumn("n_changes", changed), F.col("lines"), F.col("fixed")["text"])
    bare = F.col("n_changes").isNull()
    alone = met.withColumn("alone", F.when(bare, repaired(F.col("raw_text"), F.col("conf"))))
    text = F.when(bare, F.when(is_blank(F.col("raw_text")), "").otherwise(F.col("alone.text"))).when(F.col("text") == "", F.col("raw_text")).otherwise(F.col("text"))
    done = alone.select("page", "words", text.alias("text"), F.when(bare, F.col("alone.n")).otherwise(F.col("n_changes")).cast("bigint").alias("n_changes"))
    return outcomes(done, grid).select("page", "text", "n_changes", "near_miss", "has_table")
