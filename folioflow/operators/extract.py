"""Rules of multi-page extraction: which text wins, which pages count, how units merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chars import trim, utf16_length
from ..functions.text import join_sections, normalize_layout, visible_chars
from .layout import EMPTY_SECTION, sections_of

# Thresholds of the rules.
MIN_LAYER_CHARS, WEAK_LENGTH, WEAK_CONFIDENCE, LONGER, MIN_WORDS = 20, 12, 0.5, 1.2, 6


def trimmed_length(s: Column) -> Column:
    return utf16_length(trim(s))


def choose_page_text(layer: Column, ocr: Column) -> tuple[Column, Column]:
    """Text of a page, and whether recognition was tried: a layer of few visible characters gives
    way to recognised text with strictly more of them."""
    own = normalize_layout(layer)
    tried = visible_chars(own) < MIN_LAYER_CHARS
    return F.when(tried & (visible_chars(ocr) > visible_chars(own)), ocr).otherwise(own), tried


def limit_pages(pages: DataFrame, doc: str, page: str, most: Column, decision: Column) -> DataFrame:
    """Pages to work on. Documents over their limit (null: none) follow the decision "all", "first"
    or "cancel"; without one the first pages are taken."""
    n = F.count("*").over(W.partitionBy(doc))
    over = F.coalesce(n > most, F.lit(False))
    keep = F.when(~over | (decision == "all"), True).when(decision == "cancel", False).otherwise(F.col(page) <= most)
    return pages.withColumn("_keep", F.coalesce(keep, F.col(page) <= most)).where("_keep").drop("_keep")


def limit_batch(items: DataFrame, batch: str, order: str, most: int) -> DataFrame:
    """The first items of every batch."""
    return items.withColumn("_place", F.row_number().over(W.partitionBy(batch).orderBy(order))).where(F.col("_place") <= most).drop("_place")


def is_weak(text: Column, confidence: Column) -> Column:
    return (trimmed_length(text) < WEAK_LENGTH) | F.coalesce(confidence < WEAK_CONFIDENCE, F.lit(False))


def is_better(text: Column, confidence: Column, other: Column, other_confidence: Column) -> Column:
    """Whether a second result beats a first one."""
    a, b = trimmed_length(text), trimmed_length(other)
    return F.when(a > b * F.lit(LONGER), True).when(a < b, False).when(confidence.isNull() | other_confidence.isNull(), a > b).otherwise(confidence > other_confidence)


def merge_units(units: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Documents from units (key, order, text, raw_text, changes, has_table, near_miss; text null where the
    unit failed): texts and raw texts joined, changes summed, near_miss only without any table;
    failed where every section is blank."""
    text = F.coalesce("text", F.lit(""))
    docs = units.groupBy(key).agg(
        sections_of(order, text).alias("sections"),
        sections_of(order, F.when(F.col("text").isNull(), "").otherwise(F.coalesce("raw_text", F.lit("")))).alias("raw"),
        F.count("*").alias("units"),
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("changes"))), F.lit(0)).alias("changes"),
        F.bool_or(F.col("text").isNotNull() & F.col("has_table")).alias("has_table"),
        F.bool_or(F.col("text").isNotNull() & F.col("near_miss")).alias("near"),
    )
    failed = F.forall("sections", lambda s: trim(s) == "")
    joined = lambda c: F.when(~failed, join_sections(F.col(c), label, EMPTY_SECTION))
    return docs.select(key, joined("sections").alias("text"), joined("raw").alias("raw_text"), "units", "changes", (F.col("near") & ~F.col("has_table")).alias("near_miss"), failed.alias("failed"))


def word_extent(words: DataFrame, page: str) -> DataFrame:
    """Where to look for ruling lines: a page's word extent, and whether it is worth it."""
    box = words.groupBy(page).agg(F.count("*").alias("n"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
    return box.withColumn("search", (F.col("n") >= MIN_WORDS) & (F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))


def searchable_words(words: DataFrame, width: Column, height: Column) -> DataFrame:
    """Words with their boxes as shares of the page, clipped; blank, flat and collapsed ones go."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    kept = words.where((trim(F.col("text")) != "") & (F.col("l") != F.col("r")) & (F.col("t") != F.col("b")) & (width > 0) & (height > 0))
    out = kept.withColumns({"text": trim(F.col("text")), "l": clip(F.col("l") / width), "t": clip(F.col("t") / height), "r": clip(F.col("r") / width), "b": clip(F.col("b") / height)})
    return out.where("r > l and b > t")


def origin_line(is_pdf: Column, units: Column, ocr_units: Column, source_pages: Column, updated: Column) -> Column:
    """Where a result came from, as shown under it."""
    pages = F.when(source_pages > units, F.concat(F.lit("ilk "), units.cast("string"), F.lit(" / "), source_pages.cast("string"), F.lit(" sayfa"))).otherwise(F.concat(units.cast("string"), F.lit(" sayfa")))
    how = F.when(ocr_units == 0, "metin doğrudan okundu").when(ocr_units >= units, "OCR ile okundu").otherwise(F.concat(ocr_units.cast("string"), F.lit(" sayfa OCR ile okundu")))
    photo = F.when(units > 1, F.concat(units.cast("string"), F.lit(" fotoğraf · OCR ile okundu"))).otherwise("Fotoğraftan OCR ile okundu")
    return F.concat(F.when(is_pdf, F.concat(F.lit("PDF · "), pages, F.lit(" · "), how)).otherwise(photo), F.when(updated, " · Kaydedildi").otherwise(" · Hataları düzeltebilirsiniz"))


def has_raw_difference(text: Column, raw: Column) -> Column:
    return F.coalesce((trim(raw) != "") & (trim(raw) != trim(text)), F.lit(False))


def is_partial(units: Column, source_pages: Column) -> Column:
    return F.coalesce(source_pages > units, F.lit(False))


def primary_tables(tables: DataFrame, key: str, order: str) -> DataFrame:
    """The first table of each document, from one row per table."""
    return tables.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def can_build_searchable(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, searchable): whether any page of a document has text to lay over its image."""
    return pages.groupBy(key).agg(F.coalesce(F.bool_or(trim(F.col(text)) != ""), F.lit(False)).alias("searchable"))
