"""Queries over layout, extraction rules and the document store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars, dates
from ..functions.text import document_title
from ..operators import extract, layout, store
from ..operators.stages import scratch
from ..sources import files, textfiles
from ..sources.snapshots import Snapshots
from . import sqltext as q
from .sources import table

_NL, _PARA = "chr(10)", "chr(10) || chr(10)"
_EMPTY = q.quoted(layout.EMPTY_SECTION)


def _joined(text: str, order: str, label: str, where: str = "") -> str:
    """SQL aggregate: sections joined with headings."""
    t = q.trim(text)
    return f"case when count(*) = 1 then any_value({t}) else string_agg('{label} ' || rn || {_NL} || case when {t} = '' then {_EMPTY} else {t} end, {_PARA} order by {order}) end"


def pages(spark, sf_dir):
    """Conversations as documents of pages, some of them blank."""
    conv = table(spark, sf_dir, "conversations")
    blank = (F.col("conv_id") + F.col("turn")) % 9 == 0
    return conv.select("conv_id", "turn", (F.col("turn") + 1).alias("page"), "role", F.when(blank, "  \n").otherwise(F.col("text")).alias("text"))


_PAGES = "(select conv_id, turn, turn + 1 as page, role, case when (conv_id + turn) % 9 = 0 then '  ' || chr(10) else text end as text, row_number() over (partition by conv_id order by turn) as rn from conversations)"


def join_sections(spark, sf_dir):
    return layout.merge_sections(pages(spark, sf_dir), "conv_id", "turn", "Sayfa")


JOIN_SECTIONS = f"select conv_id, {_joined('text', 'turn', 'Sayfa')} as text, count(*) as units from {_PAGES} group by conv_id"


def lines(spark, sf_dir):
    """Order lines as text lines in blocks of three, with wide and narrow gaps and blank lines."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order) - 1)
    block = F.floor(F.col("rn") / 3).cast("int")
    top = (F.col("rn") * 20 + block * (F.col("l_orderkey") % 4) * 8).cast("double")
    text = F.when((F.col("l_partkey") % 5 == 0) | ((F.col("l_orderkey") % 7 == 0) & (block == 1)), "  \t").otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.col("l_partkey").cast("string"), F.lit("\t")))
    return li.select(F.col("l_orderkey").alias("page"), block.alias("block"), F.col("rn").alias("line"), text.alias("text"), top.alias("top"), (top + 18).alias("bottom"))


_LINES = """(select l_orderkey as page, rn // 3 as block, rn as line, case when l_partkey % 5 = 0 or (l_orderkey % 7 = 0 and rn // 3 = 1) then '' else l_returnflag || l_partkey end as text,
  cast(rn * 20 + (rn // 3) * (l_orderkey % 4) * 8 as double) as top from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as rn from lineitem))"""


def format_blocks(spark, sf_dir):
    return layout.format_blocks(lines(spark, sf_dir))


FORMAT_BLOCKS = f"""with l as {_LINES},
b as (select page, block, min(top) as top, max(top + 18) as bottom, string_agg(text, {_NL} order by line) filter (where text <> '') as text from l group by page, block),
g as (select *, top - lag(bottom) over (partition by page order by block) as gap from b where text is not null)
select p.page, coalesce(string_agg(case when gap is null then '' when gap > 18 * 0.8::double then {_PARA} else {_NL} end || text, '' order by block), '') as text
from (select distinct page from l) p left join g on p.page = g.page group by p.page"""


def page_texts(spark, sf_dir):
    """Pages with a text layer of 0, 10, 19, 20 or 21 characters and recognised text."""
    solid = F.regexp_replace("text", "[^A-Za-z]", "")
    cut = pages(spark, sf_dir).withColumn("layer", F.expr("substring(regexp_replace(text, '[^A-Za-z]', 'x'), 1, element_at(array(0, 10, 19, 20, 21), cast(turn % 5 + 1 as int)))"))
    return cut.withColumn("ocr", F.when(F.col("conv_id") % 4 == 0, F.substring(solid, 1, 10)).otherwise(F.col("text")))


_PAGE_TEXTS = f"(select conv_id, turn, text, substring(regexp_replace(text, '[^A-Za-z]', 'x', 'g'), 1, [0, 10, 19, 20, 21][turn % 5 + 1]) as layer, case when conv_id % 4 = 0 then substring(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 10) else text end as ocr from {_PAGES})"


def text_layer_vs_ocr(spark, sf_dir):
    text, tried = extract.choose_page_text(F.col("layer"), F.col("ocr"))
    return page_texts(spark, sf_dir).select("conv_id", "turn", text.alias("text"), tried.alias("tried"))


_VIS = lambda e: f"length({q.sub(e, f'[{chars.REGEX_WS}]')})"
TEXT_LAYER = f"""select conv_id, turn, case when {_VIS('own')} < 20 and {_VIS('ocr')} > {_VIS('own')} then ocr else own end as text, {_VIS('own')} < 20 as tried
from (select conv_id, turn, {q.layout('layer')} as own, ocr from {_PAGE_TEXTS})"""


def page_limit(spark, sf_dir):
    doc = pages(spark, sf_dir).select("conv_id", "page")
    most = F.when(F.col("conv_id") % 5 != 4, F.lit(3))
    decision = F.element_at(F.array(F.lit("all"), F.lit("first"), F.lit("cancel"), F.lit(None)), (F.col("conv_id") % 4 + 1).cast("int"))
    return extract.limit_pages(doc, "conv_id", "page", most, decision)


PAGE_LIMIT = f"""select conv_id, page from (select conv_id, page, count(*) over (partition by conv_id) as n from {_PAGES})
where conv_id % 5 = 4 or n <= 3 or conv_id % 4 = 0 or (conv_id % 4 in (1, 3) and page <= 3)"""


def batch_limit(spark, sf_dir):
    return extract.limit_batch(pages(spark, sf_dir).select("conv_id", "turn"), "conv_id", "turn", 3)


BATCH_LIMIT = f"select conv_id, turn from {_PAGES} where rn <= 3"


def ocr_choice(spark, sf_dir):
    """Weak first results, and whether the second pass beats them."""
    p = page_texts(spark, sf_dir)
    a = F.when(F.col("turn") % 3 != 0, (F.col("conv_id") % 10) / 10.0)
    b = F.when(F.col("turn") % 4 != 0, (F.col("conv_id") % 7) / 7.0)
    return p.select("conv_id", "turn", extract.is_weak(F.col("layer"), a).alias("weak"), extract.is_better(F.col("layer"), a, F.col("ocr"), b).alias("better"))


_LEN = lambda e: f"length({q.trim(e)})"
OCR_CHOICE = f"""select conv_id, turn, x < 12 or coalesce(a < 0.5::double, false) as weak, case when x > y * 1.2::double then true when x < y then false when a is null or b is null then x > y else a > b end as better
from (select conv_id, turn, {_LEN('layer')} as x, {_LEN('ocr')} as y, case when turn % 3 <> 0 then (conv_id % 10) / 10.0::double end as a, case when turn % 4 <> 0 then (conv_id % 7) / 7.0::double end as b from {_PAGE_TEXTS})"""


def merge_units(spark, sf_dir):
    c = F.col
    units = pages(spark, sf_dir).select("conv_id", "turn", F.when((c("conv_id") + c("turn")) % 7 != 0, F.when(c("conv_id") % 11 == 0, F.lit(" ")).otherwise(c("text"))).alias("text"), F.concat(F.lit("raw "), c("role")).alias("raw_text"), (c("turn") % 3).alias("changes"), (c("conv_id") % 6 == c("turn")).alias("has_table"), (c("turn") % 2 == 1).alias("near_miss"))
    return extract.merge_units(units, "conv_id", "turn", "Görsel")


MERGE_UNITS = f"""with u as (select conv_id, turn, rn, (conv_id + turn) % 7 = 0 as lost, case when (conv_id + turn) % 7 = 0 then '' when conv_id % 11 = 0 then ' ' else text end as text,
  case when (conv_id + turn) % 7 = 0 then '' else 'raw ' || role end as raw, turn % 3 as ch, conv_id % 6 = turn as tab, turn % 2 = 1 as near from {_PAGES})
select conv_id, case when not failed then text end as text, case when not failed then raw end as raw_text, units, changes, near and not tab as near_miss, failed from (
select conv_id, {_joined('text', 'turn', 'Görsel')} as text, {_joined('raw', 'turn', 'Görsel')} as raw, count(*) as units, cast(coalesce(sum(ch) filter (where not lost), 0) as bigint) as changes,
bool_or(not lost and near) as near, bool_or(not lost and tab) as tab, bool_and({q.trim('text')} = '') as failed from u group by conv_id)"""


def result_rules(spark, sf_dir):
    """Origin line, partial results, raw differences, dirty state and titles."""
    c = F.col
    d = table(spark, sf_dir, "documents").withColumns({"units": c("doc_id") % 4 + 1, "ocr": c("doc_id") % 6, "pages": F.when(c("doc_id") % 3 != 0, c("doc_id") % 9), "raw": F.when(c("doc_id") % 5 != 0, F.when(c("doc_id") % 2 == 0, F.concat(c("text"), F.lit(" \n"))).otherwise(c("lang")))})
    ts = F.make_timestamp(F.lit(2024), (c("doc_id") % 12 + 1).cast("int"), (c("doc_id") % 28 + 1).cast("int"), F.lit(9), F.lit(5), F.lit(0))
    title = F.when(c("doc_id") % 8 == 0, F.lit("  ")).when(c("doc_id") % 8 == 1, F.lit(None)).otherwise(F.substring("text", 1, 100))
    return d.select(
        "doc_id",
        extract.origin_line(c("doc_id") % 2 == 0, c("units"), c("ocr"), c("pages"), c("doc_id") % 7 == 0).alias("origin"),
        extract.is_partial(c("units"), c("pages")).alias("partial"),
        extract.has_raw_difference(c("text"), c("raw")).alias("raw_differs"),
        store.is_dirty(c("raw"), c("text")).alias("dirty"),
        document_title(F.coalesce(title, F.lit("")), ts).alias("title"),
        store.title_for_files(title, F.when(c("doc_id") % 16 < 8, c("source")), dates.file_stamp(ts)).alias("file_title"),
    )


_PG = "case when pages > units then 'ilk ' || units || ' / ' || pages || ' sayfa' else units || ' sayfa' end"
_TT = q.trim("title")
RESULT_RULES = f"""select doc_id, case when doc_id % 2 = 0 then 'PDF · ' || {_PG} || ' · ' || case when ocr = 0 then 'metin doğrudan okundu' when ocr >= units then 'OCR ile okundu' else ocr || ' sayfa OCR ile okundu' end
 when units > 1 then units || ' fotoğraf · OCR ile okundu' else 'Fotoğraftan OCR ile okundu' end || case when doc_id % 7 = 0 then ' · Kaydedildi' else ' · Hataları düzeltebilirsiniz' end as origin,
coalesce(pages > units, false) as "partial", coalesce({q.trim('raw')} <> '' and {q.trim('raw')} <> {q.trim('text')}, false) as raw_differs,
case when raw is not null then raw <> text else {q.trim('text')} <> '' end as dirty,
case when {q.trim(f"substring({q.trim('coalesce(title, chr(32))')}, 1, 80)")} = '' then strftime(ts, 'Belge - %d.%m.%Y') else {q.trim(f"substring({_TT}, 1, 80)")} end as title,
case when {_TT} <> '' then {_TT} when doc_id % 16 < 8 then source else strftime(ts, 'Folio_%Y%m%d_%H%M') end as file_title
from (select *, doc_id % 4 + 1 as units, doc_id % 6 as ocr, case when doc_id % 3 <> 0 then doc_id % 9 end as pages, case when doc_id % 5 <> 0 then case when doc_id % 2 = 0 then text || ' ' || chr(10) else lang end end as raw,
 make_timestamp(2024, doc_id % 12 + 1, doc_id % 28 + 1, 9, 5, 0) as ts, case when doc_id % 8 = 0 then '  ' when doc_id % 8 = 1 then null else substring(text, 1, 100) end as title from documents)"""


def log(spark, sf_dir):
    """Conversations as a change log: a version per turn, deletions, and one truncation."""
    conv = table(spark, sf_dir, "conversations")
    at = F.col("conv_id") * 10 + F.col("turn")
    saves = conv.select(F.col("conv_id").alias("id"), (F.col("turn") * 2).alias("seq"), at.alias("at"), F.lit("save").alias("op"), F.substring("text", 1, 20).alias("title"), "text", F.col("role").alias("source"))
    gone = conv.where("conv_id % 5 = 0 and turn = 2").select(F.col("conv_id").alias("id"), F.lit(5).cast("bigint").alias("seq"), at.alias("at"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    return saves.unionAll(gone)


def store_state(spark, sf_dir):
    return store.replay(log(spark, sf_dir))


_STATE = """(select id, generation, arg_max(title, turn) as title, arg_max(text, turn) as text, min(ats) as created_at, max(ats) as updated_at, arg_min(role, turn) as source from
(select conv_id as id, turn, role, text, substring(text, 1, 20) as title, conv_id * 10 + turn as ats, case when conv_id % 5 = 0 and turn > 2 and exists (select 1 from conversations y where y.conv_id = x.conv_id and y.turn = 2) then 1 else 0 end as generation, conv_id % 5 = 0 and exists (select 1 from conversations y where y.conv_id = x.conv_id and y.turn = 2) as del from conversations x)
where not (del and generation = 0) group by id, generation)"""
STORE_STATE = f"select id, cast(generation as bigint) as generation, title, text, created_at, updated_at, source from {_STATE}"


def store_truncate(spark, sf_dir):
    """State where everything was deleted once, halfway through the log."""
    entries = log(spark, sf_dir)
    half = entries.agg(F.floor(F.max("at") / 2).cast("bigint").alias("at")).select(F.lit(None).cast("bigint").alias("id"), F.lit(1 << 30).cast("bigint").alias("seq"), "at", F.lit("delete_all").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("title", "text", "source")])
    return store.replay(store.since_truncate(entries.unionAll(half))).select("id", "generation", "created_at", "updated_at", "source")


STORE_TRUNCATE = """with half as (select max(conv_id * 10 + turn) // 2 as h from conversations),
e as (select conv_id as id, turn, role, conv_id * 10 + turn as ats from conversations, half where conv_id * 10 + turn > h),
g as (select e.*, case when id % 5 = 0 and turn > 2 and exists (select 1 from e y where y.id = e.id and y.turn = 2) then 1 else 0 end as generation, id % 5 = 0 and exists (select 1 from e y where y.id = e.id and y.turn = 2) as del from e)
select id, cast(generation as bigint) as generation, min(ats) as created_at, max(ats) as updated_at, arg_min(role, turn) as source from g where not (del and generation = 0) group by id, generation"""


def recent_documents(spark, sf_dir):
    top = store.recent(store.replay(log(spark, sf_dir)), "id", "generation")
    return top.select("id", "generation", "title", "updated_at")


RECENT = f"select id, cast(generation as bigint) as generation, title, updated_at from {_STATE} order by updated_at desc, id, generation limit 5"


def find_document(spark, sf_dir):
    return store.find(store.replay(log(spark, sf_dir)), "id", 7).select("id", "title", "updated_at")


FIND = f"select id, title, updated_at from {_STATE} where id = 7"


def stored(spark, sf_dir):
    """Conversations as stored JSON files, good, bare, partly bad and unreadable."""
    c = F.col
    conv = table(spark, sf_dir, "conversations")
    made = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (c("turn") + 1).cast("int"), F.lit(10), F.lit(30), F.lit(0))
    rows = conv.select("conv_id", F.when(c("turn") % 4 != 3, F.concat(F.lit("d"), c("turn").cast("string"))).alias("id"), F.when(c("turn") % 2 == 0, F.substring("text", 1, 12)).alias("title"), "text", F.when(c("turn") % 3 == 0, F.lit("yesterday")).otherwise(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("createdAt"), F.when(c("turn") % 5 != 1, F.lit("2024-06-01T08:00:00.000")).alias("updatedAt"), F.when(c("turn") % 2 == 0, F.lit("pdf")).otherwise(c("role")).alias("source"), "turn")
    lists = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("id", "title", "text", "createdAt", "updatedAt", "source").alias("d")))), lambda x: x["d"]).alias("documents"))
    bare = F.to_json("documents")
    whole = F.to_json(F.struct(F.lit(1).alias("version"), "documents"))
    return lists.select("conv_id", F.when(c("conv_id") % 10 == 9, F.concat(F.lit("{broken"), bare)).when(c("conv_id") % 2 == 0, bare).otherwise(whole).alias("json"))


def store_load(spark, sf_dir):
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    rows = store.load(stored(spark, sf_dir), "json", now)
    return rows.select("conv_id", "id", "title", "text", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"), "source")


_LOADED = """(select conv_id, 'd' || turn as id, case when turn % 2 = 0 then substring(text, 1, 12) else '' end as title, text,
case when turn % 3 = 0 then '2030-01-01 00:00:00' else strftime(make_timestamp(2024, 1, turn + 1, 10, 30, 0), '%Y-%m-%d %H:%M:%S') end as created, case when turn % 5 <> 1 then '2024-06-01 08:00:00' end as upd, case when turn % 2 = 0 then 'pdf' else 'unknown' end as source from conversations where turn % 4 <> 3 and conv_id % 10 <> 9)"""
STORE_LOAD = f"select conv_id, id, title, text, created, coalesce(upd, created) as updated, source from {_LOADED}"


def store_roundtrip(spark, sf_dir):
    """Loaded documents, written as JSON and loaded again."""
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    again = store.load(store.dump(store.load(stored(spark, sf_dir), "json", now), "conv_id"), "json", F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    return again.select("conv_id", "id", "title", "text", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "source")


STORE_ROUNDTRIP = f"select conv_id, id, title, text, created, source from {_LOADED}"

def store_versions(spark, sf_dir):
    """Every version of a store that was written, added to and replaced, as its readers see it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    store = Snapshots(spark, scratch(spark, "versions"))
    store.write(docs.where("doc_id % 3 <> 0"))
    store.append(docs.where("doc_id % 3 = 0"))
    store.write(store.read().where("doc_id % 7 <> 2").withColumn("n_chars", F.col("n_chars") + 1))
    seen = [store.read(v).select(F.lit(v).cast("bigint").alias("version"), "*") for v in store.versions()]
    return reduce(DataFrame.unionAll, seen).groupBy("version", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.bit_xor("doc_id").alias("ids"))


STORE_VERSIONS = """with v as (select 1 as version, * from documents where doc_id % 3 <> 0 union all select 2, * from documents union all select 3, * replace (n_chars + 1 as n_chars) from documents where doc_id % 7 <> 2)
select version, source, count(*) as documents, sum(n_chars)::bigint as chars, bit_xor(doc_id) as ids from v group by version, source"""


def text_files(spark, sf_dir):
    """Documents as files of their own and read again: names shared by many, names in brackets, texts with any line ends."""
    docs = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Note ("), F.col("doc_id"), F.lit(")"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("a:b "), F.col("doc_id"))).otherwise(F.col("source"))
    out = scratch(spark, "texts")
    files.write_texts(docs.select("doc_id", title.alias("title"), F.concat("text", F.lit("\r\nend\n")).alias("text")), out)
    return textfiles.read(spark, out).select("name", F.md5(F.col("text").cast("binary")).alias("digest"))


TEXT_FILES = """with t as (select doc_id, text || chr(13) || chr(10) || 'end' || chr(10) as text, case doc_id % 5 when 0 then 'Note (' || doc_id || ')' when 1 then 'a_b ' || doc_id else source end as plain from documents)
select case when count(*) over (partition by lower(plain)) > 1 or doc_id % 5 = 0 then plain || ' (' || doc_id || ')' else plain end as name, md5(text) as digest from t"""


QUERIES = {
    "store_versions": (store_versions, STORE_VERSIONS),
    "text_files": (text_files, TEXT_FILES),
    "join_sections": (join_sections, JOIN_SECTIONS),
    "format_blocks": (format_blocks, FORMAT_BLOCKS),
    "text_layer_vs_ocr": (text_layer_vs_ocr, TEXT_LAYER),
    "page_limit": (page_limit, PAGE_LIMIT),
    "batch_limit": (batch_limit, BATCH_LIMIT),
    "ocr_choice": (ocr_choice, OCR_CHOICE),
    "merge_units": (merge_units, MERGE_UNITS),
    "result_rules": (result_rules, RESULT_RULES),
    "store_state": (store_state, STORE_STATE),
    "store_truncate": (store_truncate, STORE_TRUNCATE),
    "recent_documents": (recent_documents, RECENT),
    "find_document": (find_document, FIND),
    "store_load": (store_load, STORE_LOAD),
    "store_roundtrip": (store_roundtrip, STORE_ROUNDTRIP),
}
