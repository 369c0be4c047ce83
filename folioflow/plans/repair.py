"""Queries over the repair of digit and letter confusions.

The SQL goes another way than the expressions: characters with their neighbours by lag and
lead instead of look-around patterns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chars import LETTERS, LOWER, REGEX_WS, UPPER
from ..operators import normalize
from . import sqltext as q
from .sources import table


def confused(spark, sf_dir):
    """Documents with letters turned into digits, amounts, codes and a confidence."""
    docs = table(spark, sf_dir, "documents")
    extra = F.when(F.col("doc_id") % 3 == 0, F.lit(" 2500TL NEUR5ON A2B5C9 KATL5AM se5lam 5ELAM ME2AR\t(SELAM5) 25.09.2026 a5@b.com")).otherwise(F.lit(" TR520006 PLAKA25ABC ABC-2025-5 ka2a2a gü2el\n"))
    spoilt = F.concat(F.translate(F.substring("text", 1, 2000), "zs", "25"), extra)
    conf = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 10) / 10.0)
    return docs.select("doc_id", spoilt.alias("text"), conf.alias("confidence"))


_EXTRA = "case when doc_id % 3 = 0 then ' 2500TL NEUR5ON A2B5C9 KATL5AM se5lam 5ELAM ME2AR' || chr(9) || '(SELAM5) 25.09.2026 a5@b.com' else ' TR520006 PLAKA25ABC ABC-2025-5 ka2a2a gü2el' || chr(10) end"
_MARK = " or ".join(f"contains(upper(tok), {q.quoted(m)})" for m in normalize.CURRENCY)
#: Tokens with their repaired form.
_TOKENS = f"""with d as (select doc_id, translate(substring(text, 1, 2000), 'zs', '25') || {_EXTRA} as text, case when doc_id % 7 <> 0 then (doc_id % 10) / 10.0::double end as confidence from documents),
t as (select doc_id, text, confidence, unnest(regexp_extract_all(text, {q.quoted(f'[^{REGEX_WS}]+|[{REGEX_WS}]+')})) as tok, generate_subscripts(regexp_extract_all(text, {q.quoted(f'[^{REGEX_WS}]+|[{REGEX_WS}]+')}), 1) as k from d),
kinds as (select distinct tok, regexp_extract(tok, {q.quoted(f'[{LETTERS}0-9](?s:.*[{LETTERS}0-9])?')}) as core from t where regexp_matches(tok, '[25]')),
able as (select *, len(regexp_extract_all(core, '[{LETTERS}]')) as nl, len(regexp_extract_all(core, '[0-9]')) as nd from kinds
  where regexp_matches(core, '[25]') and not (contains(tok, '@') or contains(tok, '://') or contains(tok, chr(92)) or {_MARK})),
ch as (select tok, core, unnest(string_split(core, '')) as c, generate_subscripts(string_split(core, ''), 1) as i from able where nl >= 3 and nl >= 0.6::double * (nl + nd)),
nb as (select *, lag(c) over w as p, lead(c) over w as n from ch window w as (partition by tok order by i)),
fx as (select tok, core, string_agg(case when c in ('2', '5') and coalesce(contains('{LETTERS}', p), true) and coalesce(contains('{LETTERS}', n), true) and (p is not null or n is not null)
    then case when contains('{UPPER}', coalesce(p, n)) then translate(c, '25', 'ZS') when contains('{LOWER}', coalesce(p, n)) then translate(c, '25', 'zs') else c end else c end, '' order by i) as fixed from nb group by tok, core),
r as (select t.*, case when confidence is null or confidence >= 0.35::double then coalesce(replace(t.tok, fx.core, fx.fixed), t.tok) else t.tok end as after from t left join fx using (tok))"""


def normalize_chars(spark, sf_dir):
    docs = confused(spark, sf_dir)
    return docs.select("doc_id", normalize.repair(F.col("text"), F.col("confidence")).alias("text"))


NORMALIZE_CHARS = f"{_TOKENS} select doc_id, string_agg(after, '' order by k) as text from r group by doc_id"


def normalize_changes(spark, sf_dir):
    docs = confused(spark, sf_dir).select("doc_id", F.posexplode(normalize.changes(F.col("text"), F.col("confidence"))).alias("place", "change"))
    return docs.select("doc_id", F.col("place").cast("bigint").alias("place"), "change.before", "change.after")


NORMALIZE_CHANGES = f'{_TOKENS} select doc_id, row_number() over (partition by doc_id order by k) - 1 as place, tok as "before", after as "after" from r where tok <> after'


def low_confidence(spark, sf_dir):
    """Whether the confidence gate kept a text, and how many tokens changed."""
    docs = confused(spark, sf_dir)
    c = normalize.changes(F.col("text"), F.col("confidence"))
    return docs.select("doc_id", F.coalesce(F.col("confidence") < normalize.MIN_CONFIDENCE, F.lit(False)).alias("kept"), F.size(c).cast("bigint").alias("n_changes"))


LOW_CONFIDENCE = f"{_TOKENS} select doc_id, coalesce(any_value(confidence) < 0.35::double, false) as kept, count(*) filter (where tok <> after) as n_changes from r group by doc_id"

QUERIES = {
    "normalize_chars": (normalize_chars, NORMALIZE_CHARS),
    "normalize_changes": (normalize_changes, NORMALIZE_CHANGES),
    "low_confidence": (low_confidence, LOW_CONFIDENCE),
}
