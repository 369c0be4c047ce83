"""Daily quotas with a clock that may run back, entitlements, and the interstitial cap.

The tracker is a fold over a device's operations. Its day rules are windows: an operation whose
clock is more than the tolerance behind the latest seen one changes nothing, and counts on
the later day; the effective day is the running maximum of the days that count. The
interstitial cap resets itself, which no window expresses; it is folded over rows sorted
within partitions, one row of state per user, so a long history streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shipping import shipped

# Tolerance in seconds, the free plan's limits, products that grant the paid tier.
TOLERANCE_S = 600
DAILY = {"ocr": 10, "pdf": 3, "export": 2}
MAX_PAGES, MAX_IMAGES, MAX_BYTES = 10, 3, 25 * 1024 * 1024
PRODUCTS = ["pro_monthly", "pro_yearly", "pro_lifetime"]
#: Completed operations, and seconds, between two interstitials.
EVERY, APART_S = 3, 300
USAGE_SCHEMA = "version string, date string, ocrCount string, pdfCount string, pdfExportCount string, lastSeenAt string"


def tracked(events: DataFrame) -> DataFrame:
    """Operations (device, seq, now, op, success) with rollback, and the day and count they fall to.

    `used` is the successful operations of the kind on the effective day up to and with this one.
    Operations that fail still move the clock.
    """
    order = W.partitionBy("device").orderBy("seq")
    latest = F.max("now").over(order.rowsBetween(W.unboundedPreceding, -1))
    behind = F.coalesce(F.col("now") + F.expr(f"interval {TOLERANCE_S} seconds") < latest, F.lit(False))
    # an operation on a clock that ran back can never be the latest seen, so the plain maximum is right
    seen = events.withColumn("rollback", behind)
    day = F.max(F.when(~F.col("rollback"), F.to_date("now"))).over(order)
    dated = seen.withColumn("day", day)
    kind = W.partitionBy("device", "day", "op").orderBy("seq")
    return dated.withColumn("used", F.count(F.when(F.col("success"), 1)).over(kind))


def limit_of(op: Column) -> Column:
    """The free plan's daily limit; null is unlimited."""
    out = F.lit(None).cast("int")
    for name, n in DAILY.items():
        out = F.when(op == name, F.lit(n)).otherwise(out)
    return out


def remaining(limit: Column, used: Column) -> Column:
    return F.when(limit.isNotNull(), F.greatest(limit - used, F.lit(0)))


def admitted(events: DataFrame) -> DataFrame:
    """Whether each operation was let in: fewer successes than its limit before it on its day."""
    before = F.col("used") - F.when(F.col("success"), 1).otherwise(0)
    t = tracked(events)
    return t.withColumn("admitted", F.coalesce(before < limit_of(F.col("op")), F.lit(True)))


def by_day(events: DataFrame) -> DataFrame:
    """Counters per device and effective day."""
    count = lambda op: F.count(F.when(F.col("success") & (F.col("op") == op), 1)).alias(op)
    return tracked(events).groupBy("device", "day").agg(*[count(op) for op in DAILY])


def gates(pages: Column, images: Column, size: Column, paid: Column) -> tuple[Column, Column, Column]:
    """Whether a page count, a batch and a file size are allowed; bounds included."""
    return paid | (pages <= MAX_PAGES), paid | (images <= MAX_IMAGES), paid | (size <= MAX_BYTES)


def charged_counter(source: Column, success: Column, paid: Column) -> Column:
    """The counter a finished extraction is charged to, null for none."""
    return F.when(success & ~paid, F.when(source == "pdf", "pdf").otherwise("ocr"))


def entitlement(active: Column) -> Column:
    """The product that grants the paid tier, by priority; null for the free tier."""
    return F.coalesce(*[F.when(F.array_contains(active, p), F.lit(p)) for p in PRODUCTS])


def placement(kind: Column, paid: Column) -> tuple[Column, Column]:
    """Whether a placement shows a banner, and an interstitial."""
    return ~paid & kind.isin("home", "history"), ~paid & (kind == "after_result")


def usage_file(json: Column) -> Column:
    """A stored usage record, tolerant: counters that are no positive whole numbers count as 0, a
    day that is none as ''."""
    raw = F.from_json(json, USAGE_SCHEMA)
    number = lambda c: F.greatest(F.coalesce(F.when(raw[c].rlike("^-?[0-9]{1,9}$"), raw[c].cast("bigint")), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    day = F.when(raw["date"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), raw["date"]).otherwise("")
    return F.struct(day.alias("day"), number("ocrCount").alias("ocr"), number("pdfCount").alias("pdf"), number("pdfExportCount").alias("export"))


def usage_json(day: Column, ocr: Column, pdf: Column, export: Column, seen: Column) -> Column:
    return F.to_json(F.struct(F.lit(1).alias("version"), day.alias("date"), ocr.alias("ocrCount"), pdf.alias("pdfCount"), export.alias("pdfExportCount"), seen.alias("lastSeenAt")))


def interstitials(calls: DataFrame, every: int = EVERY, apart_s: int = APART_S) -> DataFrame:
    """Calls (user, seq, at in seconds) with `shown`: the counter since the last one has reached
    `every` and the time since then `apart_s`; it keeps growing while only time is missing."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, count, last = None, 0, None
        for batch in batches:
            shown = []
            for u, at in zip(batch["user"].to_pylist(), batch["at"].to_pylist(), strict=True):
                if u != user:
                    user, count, last = u, 0, None
                count += 1
                hit = count >= every and (last is None or at - last >= apart_s)
                if hit:
                    count, last = 0, at
                shown.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown)], [*batch.schema.names, "shown"])

    rows = calls.select("user", "seq", "at").repartition("user").sortWithinPartitions("user", "seq")
    return shipped(rows).mapInArrow(fold, "user bigint, seq bigint, at double, shown boolean")
