"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, decontaminate, exact_dedup, html_extract, license_scan, pii, secrets, sentencepiece, simhash, token_alignment, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    tox = F.col("toxicity")
    return scored.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), tox["score"].alias("score"), F.when(tox["score"] >= 0.3, 1).otherwise(0).alias("predicted"), tox["n_spans"].alias("n_spans"), tox["spans"].alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.round_trip_documents(docs).select("doc_id", "pieces", "lossless")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_documents(docs).select("doc_id", "pii.*")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_documents(docs).select("doc_id", "secrets.*")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of a page table with a byte changed in about one page of 256, by a digest of its id."""
    hit = F.md5(F.col("page_id").cast("string").cast("binary")).substr(1, 2) == "07"
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit(pages, damaged(pages))


OP9_SQL = f"""
with rec as (
  select page_id, page_id // {warc.SPAN} as archive,
         octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
           || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10))) as length
  from pages),
placed as (
  select *, row_number() over w - 1 as seq, coalesce(sum(length) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as off
  from rec window w as (partition by archive order by page_id))
select archive, 0 as part, seq, 'changed' as fault, page_id, cast(off as bigint) as "offset", length
from placed where md5(cast(page_id as varchar))[1:2] = '07'
"""


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damage(table(spark, sf_dir, "conversations")))


#: The damage, the faults and the cheapest edits again, whole: the best path into each state is a list of four and a step goes over the
#: edits of one row; no step table, pieces or running digests.
OP12_SQL = r"""
with recursive crc(i, k, v) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc where k < 8),
tab as (select list(v order by i) as t from crc where k = 8),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
hit as (
  select n.*, xor(list_reduce(list_transform(string_split(key, ''), lambda c: cast(ascii(c) as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) % 20 as kind
  from named n, tab),
hurt as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, again
  from hit, unnest(case when kind = 3 then [0, 1] else [0] end) u(again) where kind <> 0),
marked as (
  select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
         row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as seen
  from hurt),
rows_ as (
  select *, case when bare = '' then 1 when seen then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         left(role, 1) as ini, row_number() over w as n, count(*) over (partition by conv_id) as total,
         lag(left(role, 1)) over w as former
  from marked window w as (partition by conv_id order by turn nulls first, role, text, seen)),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
         count(*) filter (fault = 3) as truncated, count(*) filter (n > 1 and former || ini not in ('su', 'ua', 'au')) as illegal
  from rows_ group by conv_id),
walk as (
  select conv_id, cast(0 as bigint) as n, {'c': 0, 'a': ''} as z, {'c': 99999999, 'a': ''} as s, {'c': 99999999, 'a': ''} as u, {'c': 99999999, 'a': ''} as a
  from rows_ where n = 1
  union all
  select conv_id, n, least({'c': z.c + 3, 'a': z.a || 'D'}), 
         least({'c': s.c + 3, 'a': s.a || 'D'}, {'c': z.c + case when keep and ini = 's' then e else 99999999 end, 'a': z.a || 'K'}),
         least({'c': u.c + 3, 'a': u.a || 'D'}, {'c': x.c + case when keep and ini = 'u' then e else 99999999 end, 'a': x.a || 'K'}, {'c': x.c + case when keep then 2 + e else 99999999 end, 'a': x.a || 'R'}),
         least({'c': a.c + 3, 'a': a.a || 'D'}, {'c': u.c + case when keep and ini = 'a' then e else 99999999 end, 'a': u.a || 'K'}, {'c': u.c + case when keep then 2 + e else 99999999 end, 'a': u.a || 'R'})
  from (
    select *, least(z, s, a) as x from (
      select w.conv_id, r.n, r.ini, r.fault not in (1, 2) as keep, case when r.fault = 3 then 1 else 0 end as e, w.z, w.s,
             least(w.u, {'c': w.z.c + 2, 'a': w.z.a || 'I'}, {'c': w.s.c + 2, 'a': w.s.a || 'I'}, {'c': w.a.c + 2, 'a': w.a.a || 'I'}) as u,
             least(w.a, {'c': w.u.c + 2, 'a': w.u.a || 'I'}, {'c': w.z.c + 4, 'a': w.z.a || 'II'}, {'c': w.s.c + 4, 'a': w.s.a || 'II'}) as a
      from walk w join rows_ r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1))),
done as (
  select w.conv_id, least(z, a, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': s.c + 4, 'a': s.a || 'II'}) as best
  from walk w join (select distinct conv_id, total from rows_) t on t.conv_id is not distinct from w.conv_id and t.total = w.n),
edits as (
  select conv_id, i, best.a[i] as letter, i - length(replace(best.a[1:i], 'I', '')) as inserted from done, unnest(range(1, length(best.a) + 1)) u(i)),
kept as (
  select e.conv_id, e.i, e.letter, r.role, r.text, r.ini, row_number() over (partition by e.conv_id order by e.i) as k
  from edits e left join rows_ r on e.letter <> 'I' and r.conv_id is not distinct from e.conv_id and r.n = e.i - e.inserted where e.letter <> 'D'),
lines as (
  select conv_id, i, case when letter = 'K' then role when (k - case when led then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, '') as line
  from (select *, bool_or(k = 1 and letter = 'K' and ini = 's') over (partition by conv_id) as led from kept)),
whole as (select conv_id, sha256(string_agg(line, chr(10) order by i)) as sha from lines group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id
left join done d on d.conv_id is not distinct from c.conv_id left join whole h on h.conv_id is not distinct from c.conv_id
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep=F.max).withColumnRenamed("id", "doc_id")


OP13_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_licenses": op6_licenses,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_warc": op9_warc,
    "op10_ann": op10_ann,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {"op6_licenses": license_scan.oracle(), "op9_warc": OP9_SQL, "op12_conversation_repair": OP12_SQL, "op13_exact_dedup": OP13_SQL}
