"""Dates in words and file stamps, independent of the JVM's locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]


def long(ts: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts))
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), month, F.year(ts).cast("string"))


def long_with_time(ts: Column) -> Column:
    return F.concat(long(ts), F.lit(", "), F.date_format(ts, "HH:mm"))


def short(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmm")


def day_key(ts: Column) -> Column:
    """The calendar day as text whose order is the day's."""
    return F.date_format(ts, "yyyy-MM-dd")


def suggested_file_name(title: Column, ts: Column, app: str = "Folio") -> Column:
    from .chars import trim
    from .text import sanitize

    base = F.when(trim(title) == "", F.lit(app)).otherwise(trim(title))
    return sanitize(F.concat(base, F.lit(" "), short(ts)), app)
