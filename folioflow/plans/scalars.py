"""Queries over scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, dates, geometry, text
from ..operators.search_index import SearchIndex
from ..operators.stages import scratch
from . import sqltext as q
from .sources import table

#: Forms of the alphabet that the test tables lack, put in front of a document by its id.
FORMS = ["ŞİRKET", "Şirket", "IŞIK", "ışık", "İSTANBUL", "Çğ ÖÜ", "i̇stanbul", "güneş öğle", "kâğıt hîle"]
_FORMS_SQL = "[" + ", ".join(q.quoted(f) for f in FORMS) + "]"
#: A search over those forms and the documents' words.
QUERY = "şirket The"


def turkish(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("doc_id") % len(FORMS)).cast("int") + 1)
    return docs.withColumn("text", F.concat(form, F.lit(" \t"), F.col("text")))


_TURKISH = f"(select doc_id, lang, source, n_chars, {_FORMS_SQL}[doc_id % {len(FORMS)} + 1] || ' ' || chr(9) || text as text from documents)"


def text_stats(spark, sf_dir):
    docs = turkish(spark, sf_dir)
    return docs.select("doc_id", F.length("text").cast("bigint").alias("characters"), text.word_count(F.col("text")).cast("bigint").alias("words"), text.visible_chars(F.col("text")).cast("bigint").alias("visible"))


TEXT_STATS = f"""select doc_id, length(text) as characters, len(regexp_extract_all(text, {q.quoted(f'[^{chars.STATS_WS}]+')})) as words,
length({q.sub('text', f'[{chars.REGEX_WS}]')}) as visible from {_TURKISH}"""


def fold_text(spark, sf_dir):
    docs = turkish(spark, sf_dir)
    return docs.select("doc_id", text.fold(F.substring("text", 1, 200)).alias("folded"))


FOLD_TEXT = f"select doc_id, {q.fold('substring(text, 1, 200)')} as folded from {_TURKISH}"


def history_search(spark, sf_dir):
    docs = turkish(spark, sf_dir)
    hit = text.matches(F.lit(QUERY), F.col("source"), F.col("text"))
    return docs.where(hit).select("doc_id", text.preview(F.col("text")).alias("preview"), F.lit(QUERY).alias("query"))


_LINE = q.trim(q.collapse("text"))
_PREVIEW = f"case when length({_LINE}) > 120 then {q.sub(f'substring({_LINE}, 1, 120)', chars.TRIM_RIGHT)} || '…' else {_LINE} end"
HISTORY_SEARCH = f"""select doc_id, {_PREVIEW} as preview, {q.quoted(QUERY)} as "query" from {_TURKISH}
where contains({q.fold('source')} || chr(10) || {q.fold('text')}, 'sirket') and contains({q.fold('source')} || chr(10) || {q.fold('text')}, 'the')"""


#: Searches by the index: several terms, one that crosses words' ends, short ones, one in few rows and one in none.
SEARCHES = ["şirket The", "ION", "ou a", "th", "güneş öğ", "Zzqy", "kâğıt hîle t"]


def search_index(spark, sf_dir):
    """Rows found through the trigram index, which is built in two steps: documents of odd ids are added later."""
    docs = turkish(spark, sf_dir).select("doc_id", "source", "text")
    index = SearchIndex(spark, scratch(spark, "search"))
    for rest in (0, 1):
        index.add(docs.where(F.col("doc_id") % 2 == rest), "source", "text")
    return reduce(DataFrame.unionAll, [index.search(s).select("doc_id", F.lit(s).alias("query")) for s in SEARCHES])


def _searched(search: str) -> str:
    terms = " and ".join(f"contains(whole, t.x[{k + 1}])" for k in range(len(search.split())))
    return f"""select doc_id, {q.quoted(search)} as "query" from f, (select string_split({q.fold(q.quoted(search))}, ' ') as x) t where {terms}"""


SEARCH_INDEX = f"with f as materialized (select doc_id, {q.fold('source')} || chr(10) || {q.fold('text')} as whole from {_TURKISH}) " + " union all ".join(map(_searched, SEARCHES))


def history_counts(spark, sf_dir):
    """The count line over a search: visible of all."""
    docs = turkish(spark, sf_dir)
    hit = text.matches(F.lit(QUERY), F.col("source"), F.col("text"))
    return docs.agg(F.count_if(hit).alias("visible"), F.count("*").alias("total"))


HISTORY_COUNTS = f"""select count(*) filter (where contains({q.fold('source')} || chr(10) || {q.fold('text')}, 'sirket') and contains({q.fold('source')} || chr(10) || {q.fold('text')}, 'the')) as visible, count(*) as total from {_TURKISH}"""


def preview(spark, sf_dir):
    return turkish(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"))


PREVIEW = f"select doc_id, {_PREVIEW} as preview from {_TURKISH}"

_BS = chr(92)
_CLEAN = q.sub(q.trim(q.collapse(q.sub("s", '[' + _BS * 2 + '/:*?"<>|' + _BS + 'x00-' + _BS + 'x1F]', "_"))), "[. ]+\\z")
_SANITIZE = f"case when {_CLEAN} = '' then 'Document' when length({_CLEAN}) > 80 then {q.trim(f'substring({_CLEAN}, 1, 80)')} else {_CLEAN} end"


def sanitize_name(spark, sf_dir):
    """File names from addresses, texts and strings that are nothing but forbidden characters."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("s"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 0, " ... ").otherwise(F.concat(F.col("text"), F.lit(". "))).alias("s"))
    return pages.unionAll(docs).select("id", text.sanitize(F.col("s")).alias("name"))


SANITIZE_NAME = f"select id, {_SANITIZE} as name from (select page_id as id, url as s from pages union all select doc_id, case when doc_id % 50 = 0 then ' ... ' else text || '. ' end from documents)"


def strip_extension(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    s = F.when(F.col("page_id") % 5 == 0, F.lit(".hidden")).when(F.col("page_id") % 5 == 1, F.lit("none")).otherwise(F.col("url"))
    return pages.select("page_id", text.without_extension(s).alias("stem"))


STRIP_EXTENSION = """select page_id, case when strpos(s, '.') = 0 or (length(s) - strpos(reverse(s), '.')) = 0 then s else left(s, length(s) - strpos(reverse(s), '.')) end as stem
from (select page_id, case when page_id % 5 = 0 then '.hidden' when page_id % 5 = 1 then 'none' else url end as s from pages)"""


def format_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.format_count((F.col("n_chars") - 1000) * 3701).alias("grouped"), text.format_megabytes(F.col("n_chars") * 10007).alias("megabytes"))


FORMAT_NUMBERS = """select doc_id, replace(format('{:,}', (n_chars - 1000) * 3701), ',', '.') as grouped,
(t // 10)::varchar || case when t % 10 = 0 then '' else ',' || (t % 10)::varchar end || ' MB' as megabytes
from (select doc_id, n_chars, cast(round(n_chars * 10007 / 1048576::double * 10) as bigint) as t from documents)"""


def date_formats(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", dates.long(ts).alias("long"), dates.long_with_time(ts).alias("long_time"), dates.short(ts).alias("short"), dates.file_stamp(ts).alias("stamp"), dates.day_key(ts).alias("day"), F.concat(F.lit("Belge - "), dates.short(ts)).alias("title"), dates.suggested_file_name(F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")), ts).alias("file_name"))


_MONTHS = "[" + ", ".join(q.quoted(m) for m in dates.MONTHS) + "]"
_LONG = f"day(ts)::varchar || ' ' || {_MONTHS}[month(ts)] || ' ' || year(ts)::varchar"
DATE_FORMATS = f"""select event_id, {_LONG} as "long", {_LONG} || strftime(ts, ', %H:%M') as long_time, strftime(ts, '%d.%m.%Y') as "short", strftime(ts, '%Y%m%d_%H%M') as stamp,
strftime(ts, '%Y-%m-%d') as "day", strftime(ts, 'Belge - %d.%m.%Y') as title, case when event_id % 3 = 0 then 'Folio' else event_type end || strftime(ts, ' %d.%m.%Y') as file_name from events"""


def page_sizes(spark, sf_dir):
    """Raster size of pages of any shape, also of no size, and the size for an exported image."""
    part = table(spark, sf_dir, "part")
    w, h = (F.col("p_size") * 60.0 - 120.0), F.col("p_retailprice") - F.lit(950.0)
    a, b = geometry.page_render_size(w, h)
    c, d = geometry.fitted_size(F.greatest(w, F.lit(1.0)), F.greatest(h, F.lit(1.0)) * 3)
    return part.select("p_partkey", a.alias("raster_width"), b.alias("raster_height"), c.alias("image_width"), d.alias("image_height"))


PAGE_SIZES = """select p_partkey, greatest(cast(round(w * s) as bigint), 1) as raster_width, greatest(cast(round(h * s) as bigint), 1) as raster_height,
greatest(cast(round(iw * k) as bigint), 1) as image_width, greatest(cast(round(ih * k) as bigint), 1) as image_height
from (select *, case when greatest(w, h) * (200::double / 72::double) > 2400 then 2400::double / greatest(w, h) when greatest(w, h) * (200::double / 72::double) < 1400 then 1400::double / greatest(w, h) else 200::double / 72::double end as s,
  case when greatest(iw, ih) > 1754 then 1754::double / greatest(iw, ih) else 1::double end as k
from (select p_partkey, case when a <= 0 then 595::double else a end as w, case when b <= 0 then 842::double else b end as h, greatest(a, 1::double) as iw, greatest(b, 1::double) * 3 as ih
from (select p_partkey, p_size * 60::double - 120::double as a, p_retailprice - 950::double as b from part)))"""


def progress(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    done, total = F.col("l_quantity"), (F.col("l_linenumber") - 1) * F.lit(11.0)
    fraction, percent = geometry.progress(done, total)
    return li.groupBy("l_linenumber", "l_quantity").agg(F.count("*").alias("n")).select("l_linenumber", "l_quantity", fraction.alias("fraction"), percent.alias("percent"), (total > 1).alias("determinate"))


PROGRESS = """select l_linenumber, l_quantity, f as fraction, cast(round(f * 100) as bigint) as "percent", t > 1 as determinate
from (select *, case when t <= 0 then 0::double else least(greatest(l_quantity / t, 0), 1)::double end as f from (select distinct l_linenumber, l_quantity, (l_linenumber - 1) * 11::double as t from lineitem))"""


def normalize_layout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    noisy = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" \r\n\r\n \n\t\r")), F.lit(". "), F.lit(". \r"))
    return docs.select("doc_id", text.normalize_layout(noisy).alias("layout"))


NORMALIZE_LAYOUT = f"select doc_id, {q.layout('s')} as layout from (select doc_id, replace(replace(text, chr(10), ' ' || chr(13) || chr(10) || chr(13) || chr(10) || ' ' || chr(10) || chr(9) || chr(13)), '. ', '.' || chr(160) || chr(13)) as s from documents)"


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals of many shapes in a frame of 400 x 300."""
    k = F.col("p_partkey")
    at = lambda base, step, span: (F.lit(base) + (k * step) % span).cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", *[at(*v).alias(n) for n, v in _QUAD.items()], F.lit(400.0).alias("w"), F.lit(300.0).alias("h")
    )


_QUAD = {"x0": (0, 7, 90), "y0": (0, 5, 60), "x1": (399, -11, 140), "y1": (0, 3, 80), "x2": (399, -13, 160), "y2": (299, -17, 120), "x3": (0, 19, 130), "y3": (299, -23, 150)}
_QUAD_SQL = "select p_partkey, 400::double as w, 300::double as h, " + ", ".join(f"cast({b} + (p_partkey * {s}) % {m} as double) as {n}" for n, (b, s, m) in _QUAD.items()) + " from part"


def quad_rules(spark, sf_dir):
    c = F.col
    quad = geometry.Quad((c("x0"), c("y0")), (c("x1"), c("y1")), (c("x2"), c("y2")), (c("x3"), c("y3")))
    tw, th = quad.target_size(c("w"), c("h"))
    return quads(spark, sf_dir).select("p_partkey", F.round(quad.area(), 6).alias("area"), quad.plausible(c("w"), c("h")).alias("plausible"), quad.nearly_full(c("w"), c("h")).alias("full_frame"), tw.alias("target_width"), th.alias("target_height"))


QUAD_RULES = f"""with q as ({_QUAD_SQL}),
s as (select *, sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)) as t, sqrt((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)) as b, sqrt((x0-x3)*(x0-x3)+(y0-y3)*(y0-y3)) as l, sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) as r,
 abs((x0*y1-x1*y0)+(x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y0-x0*y3))/2 as a, greatest(x0,x1,x2,x3)-least(x0,x1,x2,x3) as bw, greatest(y0,y1,y2,y3)-least(y0,y1,y2,y3) as bh from q)
select p_partkey, round(a, 6) as area,
 t >= w*0.3::double and b >= w*0.3::double and l >= h*0.3::double and r >= h*0.3::double and t <= 2*b and b <= 2*t and l <= 2*r and r <= 2*l
 and (t+b)/2/greatest((l+r)/2,1) between 0.35::double and 3 and bw > 0 and bh > 0 and a >= bw*bh*0.55::double as plausible,
 abs(x0) <= 6 and abs(y0) <= 6 and abs(x1-399) <= 6 and abs(y1) <= 6 and abs(x3) <= 6 and abs(y3-299) <= 6 and abs(x2-399) <= 6 and abs(y2-299) <= 6 as full_frame,
 least(greatest(cast(round((t+b)/2) as bigint), 32), 400) as target_width, least(greatest(cast(round((l+r)/2) as bigint), 32), 300) as target_height from s"""

QUERIES = {
    "text_stats": (text_stats, TEXT_STATS),
    "fold_text": (fold_text, FOLD_TEXT),
    "history_search": (history_search, HISTORY_SEARCH),
    "search_index": (search_index, SEARCH_INDEX),
    "history_counts": (history_counts, HISTORY_COUNTS),
    "preview": (preview, PREVIEW),
    "sanitize_name": (sanitize_name, SANITIZE_NAME),
    "strip_extension": (strip_extension, STRIP_EXTENSION),
    "format_numbers": (format_numbers, FORMAT_NUMBERS),
    "date_formats": (date_formats, DATE_FORMATS),
    "page_sizes": (page_sizes, PAGE_SIZES),
    "progress": (progress, PROGRESS),
    "normalize_layout": (normalize_layout, NORMALIZE_LAYOUT),
    "quad_rules": (quad_rules, QUAD_RULES),
}
