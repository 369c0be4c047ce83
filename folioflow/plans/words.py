"""Queries over table detection, on order lines laid out as words of pages.

Pages are tilted, sparse, ragged, paragraph-like, right-aligned or wide by their number, so
every outcome of the detector occurs.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import tables
from .sources import table

_WORDS = """with li as (
  select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as rn,
    l_partkey as pk, concat(l_returnflag, l_linestatus) as fl, cast(l_quantity as bigint) as q, cast(floor(l_extendedprice) as bigint) as pr from lineitem),
hd as (select distinct page, 0 as rn from li where page % 5 <> 4),
c as (select page, rn, 0 as col, concat('Part', cast(pk as varchar(20))) as txt, pk from li union all select page, rn, 1, fl, pk from li union all select page, rn, 2, cast(q as varchar(20)), pk from li union all select page, rn, 3, cast(pr as varchar(20)), pk from li
  union all select page, 0, 0, 'Part', 0 from hd union all select page, 0, 1, 'Flag', 0 from hd union all select page, 0, 2, 'Qty', 0 from hd union all select page, 0, 3, 'Price', 0 from hd),
w as (select page, rn, col, txt, pk from c union all select page, rn, col + 4 * k, txt, pk from c, (values (1), (2), (3)) as v(k) where page % 40 = 7),
k as (select * from w where not (rn > 0 and (page + rn * 3 + col * 5) % 11 = 0) and not (page % 6 = 3 and (page * 7 + rn * 5 + col * 3) % 4 < 2)),
g as (select page, rn, col, txt, case when page % 6 = 5 then cast(col * 62 + (rn % 4) * 23 as double) when page % 6 = 3 then cast(col * 200 + (rn * 37) % 90 as double)
  when col % 4 = 3 then cast(col * 200 + 160 - 10 * length(txt) as double) else cast(col * 200 + pk % 7 as double) end as l from k)
"""
_TILT = "cast(rn * 40 as double) + (case page % 5 when 1 then cast(0.02 as double) when 2 then cast(-0.03 as double) when 3 then cast(0.05 as double) else cast(0 as double) end) * l"
_CONF = "case when page % 4 = 0 then cast((page + rn + col) % 10 as double) / 10 end"
_BOXES = f"{_WORDS}, wd as (select page, rn * 100 + col as word_no, txt as text, l, {_TILT} as t, l + 10 * length(txt) as r, ({_TILT}) + 20 as b, {_CONF} as conf from g)"


def words(spark, sf_dir):
    """Words of pages: page, word_no, text, l, t, r, b, conf."""
    c = F.col
    # dealt out as pages, so that what is gathered by page needs no second shuffle
    lines = table(spark, sf_dir, "lineitem").withColumn("page", c("l_orderkey"))
    order = W.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = lines.select("page", F.row_number().over(order).alias("rn"), c("l_partkey").alias("pk"), F.concat("l_returnflag", "l_linestatus").alias("fl"), c("l_quantity").cast("bigint").alias("q"), F.floor("l_extendedprice").alias("pr"))
    # words of a line in one generator: expressions copied into each other, or all in one method, make code too long to be compiled
    cols = F.when(c("page") % 40 == 7, F.sequence(F.lit(0), F.lit(15))).otherwise(F.sequence(F.lit(0), F.lit(3)))
    cells = lambda rn, pk, *texts: F.transform(cols, lambda k: F.struct(rn.alias("rn"), k.alias("col"), F.when(k % 4 == 0, texts[0]).when(k % 4 == 1, texts[1]).when(k % 4 == 2, texts[2]).otherwise(texts[3]).alias("txt"), pk.alias("pk")))
    own = cells(c("rn"), c("pk"), F.concat(F.lit("Part"), c("pk").cast("string")), c("fl"), c("q").cast("string"), c("pr").cast("string"))
    head = cells(F.lit(0), F.lit(0).cast("bigint"), *map(F.lit, ("Part", "Flag", "Qty", "Price")))
    both = F.when((c("rn") == 1) & (c("page") % 5 != 4), F.concat(own, head)).otherwise(own)
    placed = F.transform(both, lambda x: F.struct(x["rn"].alias("rn"), x["col"].alias("col"), x["txt"].alias("txt"), _left(c("page"), x["rn"], x["col"], x["txt"], x["pk"]).alias("l")))
    wide = li.select("page", F.inline(placed))
    page, rn, col = c("page"), c("rn"), c("col")
    kept = wide.where(~((rn > 0) & ((page + rn * 3 + col * 5) % 11 == 0)) & ~((page % 6 == 3) & ((page * 7 + rn * 5 + col * 3) % 4 < 2)))
    tilt = F.when(page % 5 == 1, 0.02).when(page % 5 == 2, -0.03).when(page % 5 == 3, 0.05).otherwise(0.0)
    top = (rn * 40).cast("double") + tilt * c("l")
    conf = F.when(page % 4 == 0, ((page + rn + col) % 10).cast("double") / 10)
    return kept.select("page", (rn * 100 + col).alias("word_no"), c("txt").alias("text"), "l", top.alias("t"), (c("l") + 10 * F.length("txt")).alias("r"), (top + 20).alias("b"), conf.alias("conf"))


def _left(page, rn, col, text, pk):
    """Left edge of a word, by its page's kind."""
    return F.when(page % 6 == 5, col * 62 + (rn % 4) * 23).when(page % 6 == 3, col * 200 + (rn * 37) % 90).when(col % 4 == 3, col * 200 + 160 - 10 * F.length(text)).otherwise(col * 200 + pk % 7).cast("double")


def grid(spark, sf_dir):
    """Ruling lines of every third page: some between columns, some through words, one outside."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page")).distinct().where("page % 3 = 0")
    return p.select("page", F.when(F.col("page") % 2 == 0, F.array(*map(F.lit, (-20.0, 150.0, 380.0, 575.0, 2900.0)))).otherwise(F.array(*map(F.lit, (30.0, 610.0)))).alias("vertical"), F.array(*map(F.lit, (-10.0, 30.0, 70.0, 110.0))).alias("horizontal"))


_GRID = "(select distinct l_orderkey as page, case when l_orderkey % 2 = 0 then [-20.0::double, 150, 380, 575, 2900] else [30.0::double, 610] end as vertical, 4 as n_h from lineitem where l_orderkey % 3 = 0)"

#: The detector in SQL: slope by aggregation, rows by a recursive query, everything else by windows.
_SQL = _BOXES.replace("with li", "with recursive li") + """,
st as (select page, count(*) as n, median(abs(b - t)) as h, min(l) as x_min, max(r) as x_max, avg(conf) as mean_conf from wd group by page),
sg as (select page, step, sum(k * k) as score from (select wd.page, step, round(((t + b) / 2 - 0.12::double * step / 24 * ((l + r) / 2)) / greatest(h * 0.6::double, 0.001::double)) as ky, count(*) as k from wd join st using (page), (select unnest(range(-24, 25)) as step) where n >= 6 group by all) group by page, step),
sl as (select page, step, 0.12::double * step / 24 as slope from (select *, row_number() over (partition by page order by score desc, step) as o from sg) where o = 1),
ky as (select wd.*, h, (t + b) / 2 - coalesce(slope, 0) * ((l + r) / 2) as ky from wd join st using (page) left join sl using (page) where n >= 4),
so as (select *, row_number() over (partition by page order by ky, l, word_no) as i from ky),
fo as (select page, i, 0 as rw, ky as s, 1 as c from so where i = 1
  union all select so.page, so.i, case when abs(ky - s / c) <= h * 0.6::double then rw else rw + 1 end, case when abs(ky - s / c) <= h * 0.6::double then s + ky else ky end, case when abs(ky - s / c) <= h * 0.6::double then c + 1 else 1 end from fo join so on so.page = fo.page and so.i = fo.i + 1),
rw as (select so.*, rw from so join fo using (page, i)),
sz as (select page, h, x_min, x_max, mean_conf, nr, greatest(h * 0.1::double, greatest((x_max - x_min) / 4000, 0.001::double)) as bw, h * 0.1::double as pad, floor(nr * 0.25::double) as free from st join (select page, max(rw) + 1 as nr from rw group by page) using (page)),
sb as (select *, greatest(1, floor((x_max - x_min) / bw) + 1)::int as bins from sz),
iv as (select page, rw, l - pad as a, r + pad as z, x_min, bw, bins from rw join sb using (page)),
nw as (select *, case when a <= max(z) over (partition by page, rw order by a, z rows between unbounded preceding and 1 preceding) then 0 else 1 end as nw from iv),
rn_ as (select *, sum(nw) over (partition by page, rw order by a, z rows between unbounded preceding and current row) as run from nw),
mg as (select page, rw, run, greatest(0, floor((min(a) - any_value(x_min)) / any_value(bw)))::int as f, least(any_value(bins) - 1, floor((max(z) - any_value(x_min)) / any_value(bw)))::int as e from rn_ group by page, rw, run),
hs as (select page, bin, count(*) as k from (select page, unnest(range(f, e + 1)) as bin from mg) group by page, bin),
bz as (select sb.page, bin, lead(bin) over (partition by sb.page order by bin) as nx from sb join hs on sb.page = hs.page where k > free),
se as (select page, (x_min + (bin + 1) * bw + (x_min + nx * bw)) / 2 as x from bz join sb using (page) where nx > bin + 1 and (x_min + nx * bw) - (x_min + (bin + 1) * bw) + 2 * pad >= h * 0.7::double)"""


def _cells_sql(boundaries: str) -> str:
    return f""",
co as (select sb.page, h, nr, mean_conf, line_score, list_concat([x_min - 1], coalesce(xs, []), [x_max + 1]) as ed from sb left join ({boundaries}) bd using (page)),
sm as (select page, rw, l, r, t, b, text, word_no, case when l - lag(r) over (partition by page, rw order by l, word_no) < h * 0.7::double then 0 else 1 end as nw from rw),
sn as (select *, sum(nw) over (partition by page, rw order by l, word_no rows between unbounded preceding and current row) as sg from sm),
sx as (select page, rw, sg, string_agg(text, ' ' order by l, word_no) as text, min(l) as l, max(r) as r, min(t) as t, max(b) as b from sn group by page, rw, sg),
cl as (select page, generate_subscripts(ed, 1) - 1 as col, unnest(ed) as x0 from co where len(ed) between 3 and 13),
cm as (select *, lead(x0) over (partition by page order by col) as x1 from cl),
ov as (select sx.*, col, row_number() over (partition by sx.page, rw, sg order by least(r, x1) - greatest(l, x0) desc, col) as o from sx join cm on sx.page = cm.page where x1 is not null),
ce as (select page, rw, col, string_agg(text, ' ' order by l, sg) as text, min(l) as l, min(t) as t, max(r) as r, max(b) as b from ov where o = 1 group by page, rw, col),
r1 as (select page, rw, count(*) as k, bool_or(regexp_matches(text, '[0-9]')) as d from ce group by page, rw),
r2 as (select page, sum(k) as filled, count(*) filter (where k >= 2) as cons, max(k) filter (where rw = 0) as k0, bool_or(d) filter (where rw = 0) as d0, coalesce(bool_or(d) filter (where rw > 0), false) as d1 from r1 group by page),
c1 as (select ce.page, col, count(*) as k, greatest(0::double, 1 - (max(l) - min(l)) / any_value(h) / 3) as al, any_value(nr) as nr from ce join co using (page) group by ce.page, col),
c2 as (select page, count(*) filter (where k >= greatest(2, ceil(nr * 0.6::double))) as used, avg(al) filter (where k >= 2) as al from c1 group by page),
s0 as (select co.page, nr, len(ed) - 1 as nc, line_score, mean_conf, k0, d0, d1, filled / (nr * (len(ed) - 1)) * 0.30::double + cons / nr * 0.25::double + coalesce(al, 0) * 0.20::double + used / (len(ed) - 1) * 0.15::double + least(1::double, (nr - 1) / 3::double) * 0.10::double as s from co join r2 using (page) join c2 using (page)),
s1 as (select *, least(greatest((case when line_score is not null then s + (1 - s) * line_score * 0.5::double else s end) * case when mean_conf is null then 1 else 0.85::double + 0.15::double * least(greatest(mean_conf, 0), 1) end, 0), 1) as conf from s0),
de as (select p.page, co.nr as n_rows, len(ed) - 1 as n_cols, case when co.nr >= 2 then conf end as confidence,
  case when coalesce(n, 0) < 4 then 'tooFewWords' when co.nr < 2 then 'tooFewRows' when len(ed) < 3 then 'tooFewColumns' when len(ed) > 13 then 'tooManyColumns' when conf < 0.6::double then 'lowConfidence' end as reason, co.nr >= 2 and k0 = nc and not d0 and d1 as header
  from (select distinct page from wd) p left join st using (page) left join co using (page) left join s1 using (page)),
tc as (select gr.page, gr.rw, gr.col, header, coalesce(text, '') as text, coalesce(l, 0) as l, coalesce(r, 0) as r from (select page, header, rw, unnest(range(n_cols)) as col from (select *, unnest(range(n_rows)) as rw from de where reason is null)) gr left join ce on ce.page = gr.page and ce.rw = gr.rw and ce.col = gr.col)"""


_PLAIN = "select page, list(x order by x) as xs, cast(null as double) as line_score from se group by page"
#: Ruling lines on free bins, and the boundaries they give where any is accepted.
_RULED_SQL = f""",
gl as (select page, unnest(vertical) as x from {_GRID}),
ac as (select gl.page, gl.x from gl join sb using (page) left join hs on hs.page = gl.page and hs.bin = floor((gl.x - x_min) / bw) where gl.x > x_min and gl.x < x_max and coalesce(k, 0) <= free),
al_ as (select page, list(x order by x) as xs, count(*) as n from ac group by page),
ls as (select al_.page, xs, least(n / len(vertical), 1) * 0.6::double + least(n_h / (nr + 1), 1) * 0.4::double as line_score from al_ join {_GRID} g using (page) join sb using (page))"""
_WITH_GRID = "select page, coalesce(ls.xs, p.xs) as xs, ls.line_score from (select page, list(x order by x) as xs from se group by page) p full join ls using (page)"
_DECIDE = 'select page, cast(coalesce(n_rows, 0) as bigint) as n_rows, cast(coalesce(n_cols, 0) as bigint) as n_cols, round(confidence + 1e-9::double, 6) as confidence, reason, coalesce(reason = \'lowConfidence\' and confidence >= 0.35::double, false) as near_miss, case when reason is null then header end as has_header from de'


def _rounded(d):
    return d.withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6)).withColumns({c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")) for c in ("n_cols", "n_rows")})


def row_slope(spark, sf_dir):
    a = tables.Analysis(words(spark, sf_dir))
    return a.slopes.select("page", F.col("step").cast("bigint").alias("step"))


def word_stats(spark, sf_dir):
    """Median height, extent and mean confidence of pages."""
    s = tables.page_stats(tables.usable(words(spark, sf_dir)))
    return s.select("page", "n", "h", "x_min", "x_max", F.round("mean_conf", 6).alias("mean_conf"))


def row_groups(spark, sf_dir):
    return tables.Analysis(words(spark, sf_dir)).rows.select("page", "word_no", F.col("row").cast("bigint").alias("row"))


def coverage_histogram(spark, sf_dir):
    """Bins that any interval covers, and by how many."""
    s = tables.Analysis(words(spark, sf_dir)).steps.where("count > 0")
    return s.select("page", F.explode(F.sequence("from", "to")).alias("bin"), "count").select("page", F.col("bin").cast("bigint").alias("bin"), F.col("count").cast("bigint").alias("n"))


def column_separators(spark, sf_dir):
    return tables.Analysis(words(spark, sf_dir)).separators.select("page", F.round("x", 6).alias("x"))


def ruling_boundaries(spark, sf_dir):
    return tables.ruled(tables.Analysis(words(spark, sf_dir)).laid, grid(spark, sf_dir)).select("page", F.explode("lines").alias("x"))


def line_score(spark, sf_dir):
    """How well drawn lines agree with the columns and rows of words, for pages where any line is a border."""
    found = tables.columns(tables.Analysis(words(spark, sf_dir)).laid, grid(spark, sf_dir))
    return found.where("line_score is not null").select("page", F.round("line_score", 6).alias("line_score"))


def table_cells(spark, sf_dir):
    c = tables.Analysis(words(spark, sf_dir)).table_cells()
    return c.select("page", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "text", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


def table_confidence(spark, sf_dir):
    return _rounded(tables.Analysis(words(spark, sf_dir)).decisions())


def table_confidence_ruled(spark, sf_dir):
    return _rounded(tables.Analysis(words(spark, sf_dir), grid(spark, sf_dir)).decisions())


def aligned_text(spark, sf_dir):
    return tables.aligned_text(tables.Analysis(words(spark, sf_dir)).table_cells())


def cell_update(spark, sf_dir):
    """Tables with the cell in row 2, column 1 overwritten, as shapes."""
    c = tables.update_cell(tables.Analysis(words(spark, sf_dir)).table_cells(), 2, 1, "edited 1")
    s = tables.shape(c)
    return s.select("page", F.col("rows").cast("bigint").alias("rows"), F.col("cols").cast("bigint").alias("cols"), "filled", F.array_join("header", "|").alias("header"), F.array_join("body", "|").alias("body"))


ALIGNED = f"""{_SQL}{_cells_sql(_PLAIN)},
wt as (select *, max(length(text)) over (partition by page, col) as wd_, max(col) over (partition by page) as lc from tc),
ln as (select page, rw, rtrim(string_agg(case when col = lc then text else rpad(text, cast(wd_ as integer), ' ') end, '  ' order by col)) as line from wt group by page, rw)
select page, string_agg(line, chr(10) order by rw) as text from ln group by page"""
CELL_UPDATE = f"""{_SQL}{_cells_sql(_PLAIN)},
ed_ as (select page, rw, col, header, case when rw = 2 and col = 1 then 'edited 1' else text end as text from tc)
select page, max(rw) + 1 as "rows", max(col) + 1 as cols, count(*) filter (where text <> '') as filled, case when any_value(header) then string_agg(text, '|' order by col) filter (where rw = 0) end as header,
case when any_value(header) then string_agg(text, '|' order by col) filter (where rw = 1) else string_agg(text, '|' order by col) filter (where rw = 0) end as body from ed_ group by page"""

QUERIES = {
    "word_stats": (word_stats, f"{_SQL} select page, n, h, x_min, x_max, round(mean_conf, 6) as mean_conf from st"),
    "row_slope": (row_slope, f"{_SQL} select page, step from sl join st using (page) where n >= 4"),
    "row_groups": (row_groups, f'{_SQL} select page, word_no, rw as "row" from rw'),
    "coverage_histogram": (coverage_histogram, f"{_SQL} select page, bin, k as n from hs"),
    "column_separators": (column_separators, f"{_SQL} select page, round(x, 6) as x from se"),
    "ruling_boundaries": (ruling_boundaries, f"{_SQL}{_RULED_SQL} select page, x from ac"),
    "line_score": (line_score, f"{_SQL}{_RULED_SQL} select page, round(line_score, 6) as line_score from ls"),
    "table_cells": (table_cells, f'{_SQL}{_cells_sql(_PLAIN)} select page, rw as "row", col, text, round(l, 6) as l, round(r, 6) as r from tc'),
    "table_confidence": (table_confidence, f"{_SQL}{_cells_sql(_PLAIN)} {_DECIDE}"),
    "table_confidence_ruled": (table_confidence_ruled, f"{_SQL}{_RULED_SQL}{_cells_sql(_WITH_GRID)} {_DECIDE}"),
    "aligned_text": (aligned_text, ALIGNED),
    "cell_update": (cell_update, CELL_UPDATE),
}
