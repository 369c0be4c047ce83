"""Layout plans of exported documents as rows; writing the bytes belongs to a PDF library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import is_blank, trim
from ..functions.dates import short
from ..functions.geometry import clamp
from ..functions.text import sanitize

# Line heights, the page, overlay fonts and limits.
LINE, SPACER, A4_W, A4_H, MIN_FONT, MAX_FONT, FONT_SHARE, LANDSCAPE_COLUMNS = 11.0, 6.0, 595.275590551181, 841.889763779528, 2.0, 72.0, 0.85, 5


def text_plan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, height, text): a spacer for blank lines; documents without text have no plan."""
    lines = docs.where(~is_blank(F.col(text))).select(key, F.posexplode(F.split(text, "\n")).alias("line", "text"))
    blank = is_blank(F.col("text"))
    return lines.select(key, "line", F.when(blank, "spacer").otherwise("line").alias("kind"), F.when(blank, SPACER).otherwise(LINE).alias("height"), "text")


def table_plan(shapes: DataFrame) -> DataFrame:
    """shapes (page, rows, cols, has_header): orientation and whether the header repeats; empty tables go."""
    return shapes.where("rows > 0 and cols > 0").select("page", "rows", "cols", (F.col("cols") >= LANDSCAPE_COLUMNS).alias("landscape"), F.coalesce("has_header", F.lit(False)).alias("repeat_header"))


def is_landscape(width: Column, height: Column) -> Column:
    return width > height


def image_plan(images: DataFrame) -> DataFrame:
    """images (id, w, h; null where unreadable): page format of each readable image and where it lies."""
    w, h = F.col("w"), F.col("h")
    wide = is_landscape(w, h)
    pw, ph = F.when(wide, A4_H).otherwise(A4_W), F.when(wide, A4_W).otherwise(A4_H)
    scale = F.least(pw / w, ph / h)
    return images.where("w > 0 and h > 0").withColumns({"landscape": wide, "draw_w": w * scale, "draw_h": h * scale, "x": (pw - w * scale) / 2, "y": (ph - h * scale) / 2})


def overlay(words: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Invisible words over their image: place and font size in points. words: boxes as shares of the image."""
    plan = image_plan(images)
    met = words.join(plan.select(F.col("id").alias("_id"), "draw_w", "draw_h", F.col("x").alias("_x"), F.col("y").alias("_y")), words[key] == F.col("_id"))
    font = clamp((F.col("b") - F.col("t")) * F.col("draw_h") * FONT_SHARE, MIN_FONT, MAX_FONT)
    return met.select(*words.columns, (F.col("_x") + F.col("l") * F.col("draw_w")).alias("x"), (F.col("_y") + F.col("t") * F.col("draw_h")).alias("y"), font.alias("font"))


def kinds(text: Column, has_table: Column, searchable: Column) -> tuple[Column, Column, Column, Column]:
    """Which exports are offered: searchable, table, text, and whether there is anything at all."""
    some = ~is_blank(text) | has_table | searchable
    return some & searchable, some & has_table, some, some


def document_title(title: Column, app: str = "Folio") -> Column:
    """Title of an exported document: the application's name where there is none."""
    return F.when(is_blank(title), F.lit(app)).otherwise(trim(title))


def suggested_name(title: Column, day: Column, app: str = "Folio") -> Column:
    """File name offered for an export: title and date."""
    return sanitize(F.concat(document_title(title, app), F.lit(" "), short(day)))


def page_marks(pages: DataFrame, page: str, title: Column) -> DataFrame:
    """Adds header and footer of each page, numbered from 1: the trimmed title on the first one (null if blank, and on
    others), and the page's number."""
    header = F.when((F.col(page) <= 1) & ~is_blank(title), trim(title))
    return pages.withColumns({"header": header, "footer": F.col(page).cast("string")})
