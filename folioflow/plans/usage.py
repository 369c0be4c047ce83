"""Queries over quotas, entitlements and the interstitial cap."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from ..operators import quota
from ..operators.stages import scratch
from ..streaming import tracker
from .sources import table

_OPS = {"view": "ocr", "click": "pdf", "purchase": "export"}


def usage(spark, sf_dir):
    """Events as operations of ten devices, with clocks that ran back by days and by minutes."""
    e = table(spark, sf_dir, "events")
    op = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _OPS.items()], F.lit("ocr"))
    now = F.when(F.col("event_id") % 97 == 5, F.col("ts") - F.expr("interval 3 days")).when(F.col("event_id") % 31 == 7, F.col("ts") - F.expr("interval 4 minutes")).otherwise(F.col("ts"))
    return e.select((F.col("user_id") % 10).alias("device"), F.col("event_id").alias("seq"), now.alias("now"), op.alias("op"), F.col("event_type").isin(list(_OPS)).alias("success"))


_USAGE = """u as (select user_id % 10 as device, event_id as seq, case when event_id % 97 = 5 then ts - interval 3 days when event_id % 31 = 7 then ts - interval 4 minutes else ts end as now_,
  case event_type when 'click' then 'pdf' when 'purchase' then 'export' else 'ocr' end as op, event_type in ('view', 'click', 'purchase') as success from events),
r as (select *, coalesce(now_ + interval 10 minutes < max(now_) over (partition by device order by seq rows between unbounded preceding and 1 preceding), false) as rollback from u),
d as (select *, max(case when not rollback then cast(now_ as date) end) over (partition by device order by seq rows between unbounded preceding and current row) as "day" from r)"""


def clock_rollback(spark, sf_dir):
    return quota.tracked(usage(spark, sf_dir)).select("device", "seq", "rollback", F.col("day").cast("string").alias("day"))


CLOCK_ROLLBACK = f'with {_USAGE} select device, seq, rollback, "day"::varchar as "day" from d'


def usage_by_day(spark, sf_dir):
    return quota.by_day(usage(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


USAGE_BY_DAY = f"""with {_USAGE} select device, "day"::varchar as "day", count(*) filter (where success and op = 'ocr') as ocr, count(*) filter (where success and op = 'pdf') as pdf, count(*) filter (where success and op = 'export') as export from d group by device, "day" """


def quota_admission(spark, sf_dir):
    return quota.admitted(usage(spark, sf_dir)).select("device", "seq", "op", "admitted")


_LIMIT = "case op when 'ocr' then 10 when 'pdf' then 3 else 2 end"
QUOTA_ADMISSION = f"""with {_USAGE} select device, seq, op, (select count(*) from d x where x.device = d.device and x."day" = d."day" and x.op = d.op and x.success and x.seq < d.seq) < {_LIMIT} as admitted from d"""


def quota_remaining(spark, sf_dir):
    """What each day of a device left of each quota."""
    days = quota.by_day(usage(spark, sf_dir))
    left = days.select("device", "day", F.expr("stack(3, 'ocr', ocr, 'pdf', pdf, 'export', export) as (op, used)"))
    return left.select("device", F.col("day").cast("string").alias("day"), "op", quota.remaining(quota.limit_of(F.col("op")), F.col("used")).alias("remaining"))


QUOTA_REMAINING = f"""with {_USAGE}, o(op) as (values ('ocr'), ('pdf'), ('export')), k as (select distinct device, "day" from d)
select k.device, k."day"::varchar as "day", o.op, greatest(case o.op when 'ocr' then 10 when 'pdf' then 3 else 2 end - (select count(*) from d where d.device = k.device and d."day" = k."day" and d.op = o.op and d.success), 0) as remaining from k, o"""


def quota_gates(spark, sf_dir):
    """Page, batch and size gates and the charged counter, for both tiers."""
    c = F.col
    d = table(spark, sf_dir, "documents")
    paid = c("doc_id") % 13 == 0
    a, b, s = quota.gates(c("doc_id") % 15, c("doc_id") % 5, c("n_chars") * 4096, paid)
    return d.select("doc_id", a.alias("pages_ok"), b.alias("batch_ok"), s.alias("size_ok"), quota.charged_counter(F.when(c("doc_id") % 3 == 0, "pdf").otherwise("camera"), c("doc_id") % 4 != 0, paid).alias("charged"))


QUOTA_GATES = """select doc_id, p or doc_id % 15 <= 10 as pages_ok, p or doc_id % 5 <= 3 as batch_ok, p or n_chars * 4096 <= 26214400 as size_ok,
case when doc_id % 4 <> 0 and not p then case when doc_id % 3 = 0 then 'pdf' else 'ocr' end end as charged from (select *, doc_id % 13 = 0 as p from documents)"""


def entitlement(spark, sf_dir):
    """The granting product of each user's purchases, unknown ones among them."""
    names = F.array(F.lit("pro_lifetime"), F.lit("other"), F.lit("pro_yearly"), F.lit("pro_monthly"))
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.collect_set(F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))).alias("active"))
    return bought.select("user_id", quota.entitlement(F.col("active")).alias("product"))


ENTITLEMENT = """select user_id, case when bool_or(event_id % 4 = 3) then 'pro_monthly' when bool_or(event_id % 4 = 2) then 'pro_yearly' when bool_or(event_id % 4 = 0) then 'pro_lifetime' end as product from events where event_type = 'purchase' group by user_id"""


def placements(spark, sf_dir):
    kinds = F.array(F.lit("home"), F.lit("history"), F.lit("after_result"), F.lit("result"))
    e = table(spark, sf_dir, "events").withColumn("kind", F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")))
    banner, inter = quota.placement(F.col("kind"), F.col("user_id") % 3 == 0)
    return e.select("event_id", banner.alias("banner"), inter.alias("interstitial"))


PLACEMENTS = "select event_id, user_id % 3 <> 0 and event_id % 4 < 2 as banner, user_id % 3 <> 0 and event_id % 4 = 2 as interstitial from events"


def usage_files(spark, sf_dir):
    """Usage records read from JSON with wrong types, signs and days."""
    c = F.col
    e = table(spark, sf_dir, "events")
    day = F.when(c("event_id") % 5 == 0, "today").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    ocr = F.when(c("event_id") % 3 == 0, F.lit('"many"')).when(c("event_id") % 3 == 1, F.lit("-4")).otherwise((c("event_id") % 11).cast("string"))
    json = F.concat(F.lit('{"version":1,"date":"'), day, F.lit('","ocrCount":'), ocr, F.lit(',"pdfCount":'), (c("user_id") % 4).cast("string"), F.when(c("event_id") % 2 == 0, F.concat(F.lit(',"pdfExportCount":'), (c("user_id") % 3).cast("string"))).otherwise(""), F.lit("}"))
    json = F.when(c("event_id") % 17 == 0, F.lit("{not json")).otherwise(json)
    return e.select("event_id", quota.usage_file(json).alias("u")).select("event_id", F.coalesce("u.day", F.lit("")).alias("day"), F.coalesce("u.ocr", F.lit(0)).alias("ocr"), F.coalesce("u.pdf", F.lit(0)).alias("pdf"), F.coalesce("u.export", F.lit(0)).alias("export"))


USAGE_FILES = """select event_id, case when event_id % 17 = 0 or event_id % 5 = 0 then '' else strftime(ts, '%Y-%m-%d') end as "day", case when event_id % 17 <> 0 and event_id % 3 = 2 then event_id % 11 else 0 end as ocr,
case when event_id % 17 <> 0 then user_id % 4 else 0 end as pdf, case when event_id % 17 <> 0 and event_id % 2 = 0 then user_id % 3 else 0 end as export from events"""


def interstitial_cap(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("user"), F.col("event_id").alias("seq"), (F.col("event_id") * 20 + F.col("event_id") % 7).cast("double").alias("at"))
    return quota.interstitials(calls).select("user", "seq", "shown")


INTERSTITIAL_CAP = """with recursive c as (select user_id % 10 as u, event_id as seq, cast(event_id * 20 + event_id % 7 as double) as t, row_number() over (partition by user_id % 10 order by event_id) as rn from events),
f as (select u, seq, rn, 1 as n, cast(null as double) as last_, false as shown from c where rn = 1
union all select c.u, c.seq, c.rn, case when f.n + 1 >= 3 and (f.last_ is null or c.t - f.last_ >= 300) then 0 else f.n + 1 end, case when f.n + 1 >= 3 and (f.last_ is null or c.t - f.last_ >= 300) then c.t else f.last_ end, f.n + 1 >= 3 and (f.last_ is null or c.t - f.last_ >= 300)
from f join c on c.u = f.u and c.rn = f.rn + 1)
select u as "user", seq, shown from f"""

@contextlib.contextmanager
def _rocks(spark):
    before = spark.conf.get(tracker.PROVIDER)
    spark.conf.set(tracker.PROVIDER, tracker.ROCKS)
    yield
    spark.conf.set(tracker.PROVIDER, before)


def usage_stream(spark, sf_dir):
    """The tracker's decisions from a stream that brings every operation twice and out of order, and is stopped and started again
    half way. A last file moves the watermark behind all of them."""
    path, rows = scratch(spark, "usage"), usage(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60 + 86400))
    log = rows.select("device", "seq", "ts", "now", "op", "success")
    half = log.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    parts = [log.where(F.col("seq") <= half), log.where(F.col("seq") > half), log.where(F.col("seq") == half).withColumns({"device": F.lit(-1).cast("bigint"), "ts": F.lit("2100-01-01").cast("timestamp")})]
    with _rocks(spark):
        for part in parts:
            part.unionAll(part).repartition(F.xxhash64("seq")).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(log.schema).parquet(f"{path}/in")
            out = tracker.track_usage(stream, late="1 minute").writeStream
            out.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").where("device >= 0").select("device", "seq", "rollback", "day", "used", "admitted")


USAGE_STREAM = f"""with {_USAGE}, n as (select *, count(*) filter (where success) over (partition by device, "day", op order by seq rows between unbounded preceding and current row) as used from d)
select device, seq, rollback, "day"::varchar as "day", used, used - success::int < {_LIMIT} as admitted from n"""

QUERIES = {
    "usage_stream": (usage_stream, USAGE_STREAM),
    "clock_rollback": (clock_rollback, CLOCK_ROLLBACK),
    "usage_by_day": (usage_by_day, USAGE_BY_DAY),
    "quota_admission": (quota_admission, QUOTA_ADMISSION),
    "quota_remaining": (quota_remaining, QUOTA_REMAINING),
    "quota_gates": (quota_gates, QUOTA_GATES),
    "entitlement": (entitlement, ENTITLEMENT),
    "placements": (placements, PLACEMENTS),
    "usage_files": (usage_files, USAGE_FILES),
    "interstitial_cap": (interstitial_cap, INTERSTITIAL_CAP),
}
