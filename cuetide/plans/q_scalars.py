"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuetide.functions import text as tx
from cuetide.functions import times as tm
from cuetide.operators import guards
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_joins import _TS, plain_sql
from cuetide.plans.q_runs import clean_sql, key_sql, kind_sql

_WIDE = tx.PUNCT_WIDE.replace("'", "''")


def _docs(spark, d):
    return ad.table(spark, d, "documents")


def _lines(spark, d):
    return ad.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"), F.concat(F.lit("<i>"), F.col("text"), F.lit("</i> &amp;nbsp; &lt;b&gt;  x\\N{pos}")).alias("t"))


_T = "t as (select conv_id as id, turn::bigint as turn, '<i>' || text || '</i> &amp;nbsp; &lt;b&gt;  x' || chr(92) || 'N{pos}' as t from conversations)"


@query("tx01_clean_cue", f"with {_T} select id, turn, {clean_sql('t')} as clean from t")
def tx01(spark, d):
    return _lines(spark, d).select("id", "turn", tx.clean_cue(F.col("t")).alias("clean"))


@query("tx02_clean_plain", f"with {_T} select id, turn, {plain_sql('t')} as clean from t")
def tx02(spark, d):
    return _lines(spark, d).select("id", "turn", tx.clean_plain(F.col("t")).alias("clean"))


_IMPORT = plain_sql("regexp_replace(regexp_replace(t, '\\\\[Nn]', ' ', 'g'), '\\{[^}]*\\}', '', 'g')")
for _name, _char in tx.ENTITIES_WIDE:
    _quoted = _char.replace("'", "''")
    _IMPORT = f"replace({_IMPORT}, '{_name}', '{_quoted}')"


@query("tx03_clean_import", f"with {_T} select id, turn, {_IMPORT} as clean from t")
def tx03(spark, d):
    return _lines(spark, d).select("id", "turn", tx.clean_import(F.col("t")).alias("clean"))


@query("tx04_repeat_key", f"select doc_id, {key_sql('text')} as key from documents")
def tx04(spark, d):
    return _docs(spark, d).select("doc_id", tx.repeat_key(F.col("text")).alias("key"))


@query("tx05_compact_key", f"select doc_id, regexp_replace({clean_sql('text')}, '[{tx.WS}{_WIDE}]+', '', 'g') as key from documents")
def tx05(spark, d):
    return _docs(spark, d).select("doc_id", tx.compact_key(F.col("text")).alias("key"))


@query("tx06_content_length", f"select doc_id, length(regexp_replace({clean_sql('text')}, '[{tx.WS}{tx.PUNCT.replace(chr(39), chr(39) * 2)}]+', '', 'g')) as n from documents")
def tx06(spark, d):
    return _docs(spark, d).select("doc_id", tx.content_length(F.col("text")).alias("n"))


@query("tx07_information_kind", "with w as (select distinct unnest(string_split(text, ' ')) as w from documents), " + kind_sql("w", "w", "kd") + " select w, kind from kd where kind is not null")
def tx07(spark, d):
    """Words of documents that carry little information. The kind depends on the words' count, if only in name: a filter of
    the word alone would be moved before the grouping, and tell the kind of each word of each text."""
    words = _docs(spark, d).select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return words.select("w", F.when(F.col("n") > 0, tx.information_kind(F.col("w"))).alias("kind")).where("kind is not null")


@query("tx08_join_words", "select doc_id, case when regexp_matches(text, '[\\x{3400}-\\x{9fff}]') then replace(text, ' ', '') else text end as joined from documents")
def tx08(spark, d):
    return _docs(spark, d).select("doc_id", tx.join_words(F.split("text", " ")).alias("joined"))


@query("tx09_punctuation_words", f"with w as (select unnest(string_split(text, ' ')) as w from documents) select w, count(*) as n from w where regexp_matches(w, '^[{tx.WS}{tx.PUNCT.replace(chr(39), chr(39) * 2)}]+$') group by 1")
def tx09(spark, d):
    words = _docs(spark, d).select(F.explode(F.split("text", " ")).alias("w"))
    return words.where(tx.is_punctuation(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("tx10_decode_for_urls", "select page_id, url || '&x=1' as u from pages")
def tx10(spark, d):
    return ad.table(spark, d, "pages").select("page_id", tx.decode_for_urls(F.concat("url", F.lit("&AMP;x&#61;1"))).alias("u"))


@query("tx11_model_json", "select event_id, props as json from events")
def tx11(spark, d):
    """JSON in fences or in talk."""
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), F.col("props"), F.lit(" done")))
    return ad.table(spark, d, "events").select("event_id", tx.model_json(fenced).alias("json"))


@query("tx12_error_kinds", "select event_id, case event_id % 5 when 0 then 'rate_limited' when 1 then 'content_policy' when 2 then 'permanent' else 'transient' end as kind from events")
def tx12(spark, d):
    n = F.col("event_id") % 5
    message = F.when(n == 0, "HTTP 429 quota").when(n == 1, "blocked by content policy 403").when(n == 2, "Invalid API key").when(n == 3, "timeout").otherwise(F.lit(None))
    return ad.table(spark, d, "events").select("event_id", tx.error_kind(message).alias("kind"))


@query("tx13_language_codes", "select doc_id, case doc_id % 5 when 0 then 'zh' when 1 then lang when 2 then '' when 3 then 'pt-br' else 'ja' end as code from documents")
def tx13(spark, d):
    n = F.col("doc_id") % 5
    raw = F.when(n == 0, "zh_Hans").when(n == 1, F.upper("lang")).when(n == 2, " auto ").when(n == 3, "PT_br").otherwise("Japanese")
    return _docs(spark, d).select("doc_id", tx.language_code(raw).alias("code"))


@query("tx14_content_signatures", "with h as (select item_id, text, list_reduce(list_prepend(0::hugeint, list_transform(string_split(text, ''), lambda c: unicode(c)::hugeint)), lambda h, x: (h * 31 + x) % 4294967296) as h from benchmark) select item_id, length(text) || ':' || case when h >= 2147483648 then 4294967296 - h else h end as signature from h")
def tx14(spark, d):
    return ad.table(spark, d, "benchmark").select("item_id", tx.content_signature(F.col("text")).alias("signature"))


@query("tx15_cache_keys", "select page_id, 'subtitle:v4:' || sha256('page:' || url || chr(10) || 'source:' || page_id) as key from pages")
def tx15(spark, d):
    return ad.table(spark, d, "pages").select("page_id", tx.cache_key(F.col("url"), F.col("page_id").cast("string")).alias("key"))


@query("tx16_safe_filenames", "select doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\\\\/:*?\"<>|]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80) as name from documents")
def tx16(spark, d):
    return _docs(spark, d).select("doc_id", tx.safe_filename(F.col("text")).alias("name"))


@query("tx17_unique_names", "select doc_id, source || case when row_number() over (partition by source order by doc_id) = 1 then '' else '-' || row_number() over (partition by source order by doc_id) end as name from documents")
def tx17(spark, d):
    """Names that collide get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _docs(spark, d).select("doc_id", F.concat("source", F.when(n == 1, "").otherwise(F.concat(F.lit("-"), n.cast("string")))).alias("name"))


@query("tx18_useful_titles", "select doc_id, case when doc_id % 3 = 0 then source else 'T ' || doc_id end as title from documents")
def tx18(spark, d):
    first = F.when(F.col("doc_id") % 3 == 0, " About:Blank ").otherwise(F.concat(F.lit(" T  "), F.col("doc_id").cast("string")))
    return _docs(spark, d).select("doc_id", tx.useful_title(first, F.col("source")).alias("title"))


@query("tx19_human_forms", "select doc_id, case when n_chars >= 1048576 then regexp_replace((floor(n_chars / 1048576 * 10 + 0.5) / 10)::decimal(20,1)::varchar, '\\.0$', '') || ' MB' when n_chars >= 1024 then regexp_replace((floor(n_chars / 1024 * 10 + 0.5) / 10)::decimal(20,1)::varchar, '\\.0$', '') || ' KB' else n_chars || ' B' end as size, case when n_chars >= 3600 then (n_chars // 3600) || ':' || lpad((n_chars % 3600 // 60)::varchar, 2, '0') || ':' || lpad((n_chars % 60)::varchar, 2, '0') else (n_chars // 60) || ':' || lpad((n_chars % 60)::varchar, 2, '0') end as time from documents")
def tx19(spark, d):
    n = F.col("n_chars")
    return _docs(spark, d).select("doc_id", tx.human_bytes(n).alias("size"), tx.human_duration(n.cast("double")).alias("time"))


@query("sf01_parse_timestamps", "select event_id, case when event_id % 4 = 3 then null else cast(floor((case when event_id % 4 = 2 then 0 else event_id % 24 * 3600 end + event_id % 60 * 60 + event_id % 50 + 0.25e0) * 1000 + 0.5) as bigint) end as ms from events")
def sf01(spark, d):
    n = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tail = F.concat(two(n % 60), F.lit(":"), two(n % 50))
    whole = F.when(n % 4 == 3, "soon").when(n % 4 == 2, F.concat(tail, F.lit(".250"))).otherwise(F.concat(two(n % 24), F.lit(":"), tail, F.lit(",250")))
    return ad.table(spark, d, "events").select("event_id", tm.millis(tm.parse_timestamp(whole)).alias("ms"))


@query("sf02_format_timestamps", f"select event_id, {_TS('value * 100', '.')} as vtt, {_TS('value * 100', ',')} as srt from events where value >= 0")
def sf02(spark, d):
    t = F.col("value") * 100
    return ad.table(spark, d, "events").where("value >= 0").select("event_id", tm.format_timestamp(t).alias("vtt"), tm.format_timestamp(t, ",").alias("srt"))


@query("sf03_iso_durations", "select event_id, case event_id % 4 when 0 then (event_id % 24 * 3600 + event_id % 60 * 60 + 5.5e0) * 1000 when 1 then 86400000e0 * (event_id % 7 + 1) when 2 then (event_id % 100 + 1) * 1000e0 else null end::bigint as ms from events")
def sf03(spark, d):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, F.concat(F.lit("PT"), (n % 24).cast("string"), F.lit("H"), (n % 60).cast("string"), F.lit("M5.5S"))).when(n % 4 == 1, F.concat(F.lit("P"), (n % 7 + 1).cast("string"), F.lit("D"))).when(n % 4 == 2, (n % 100 + 1).cast("string")).otherwise("P")
    return ad.table(spark, d, "events").select("event_id", tm.millis(tm.duration_value(text)).alias("ms"))


@query("sf19_first_finite", "select l_orderkey, l_linenumber::bigint as line, coalesce(case when l_tax > 0.04 then l_tax end, case when l_discount > 0.05 then l_discount end, 0e0) as picked from lineitem")
def sf19(spark, d):
    """The first of several numbers that is one and positive."""
    tax, disc = F.col("l_tax"), F.col("l_discount")
    pick = F.coalesce(tm.finite(F.when(tax > 0.04, tax).otherwise(F.lit(float("nan")))), tm.finite(F.when(disc > 0.05, disc)), F.lit(0.0))
    return ad.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), pick.alias("picked"))


@query("sf21_round_seconds", "select event_id, cast(floor((floor(value * 1000 + 0.5) / 1000e0) * 1000 + 0.5) as bigint) as ms from events")
def sf21(spark, d):
    return ad.table(spark, d, "events").select("event_id", tm.millis(tm.round_seconds(F.col("value"))).alias("ms"))


@query("sf22_request_timeouts", "select doc_id, least(1200000, greatest(180000, cast(ceil(n_chars * 1250 / 10e0) as bigint))) as timeout_ms from documents")
def sf22(spark, d):
    """1.25 s for each second of audio, between three and twenty minutes."""
    ms = F.ceil(F.col("n_chars") * 1250 / F.lit(10.0)).cast("long")
    return _docs(spark, d).select("doc_id", F.least(F.lit(1_200_000), F.greatest(F.lit(180_000), ms)).cast("long").alias("timeout_ms"))


@query("sf23_logical_boundaries", "select event_id, value > 0.001 and value < 999 and abs(value / 5e0 - floor(value / 5e0 + 0.5)) * 5 <= 0.001 as boundary from events")
def sf23(spark, d):
    v = F.col("value")
    at = F.abs(v / 5 - F.floor(v / 5 + 0.5)) * 5 <= 0.001
    return ad.table(spark, d, "events").select("event_id", ((v > 0.001) & (v < 999) & at).alias("boundary"))


@query("f14_fragmented_cjk", "select doc_id, doc_id % 2 = 0 as fragmented from documents")
def f14(spark, d):
    said = F.when(F.col("doc_id") % 2 == 0, "你好 我 在 这里").otherwise(F.col("source"))
    return _docs(spark, d).select("doc_id", guards.is_fragmented_cjk(said).alias("fragmented"))


@query("p05_request_headers", "select page_id, case when page_id % 2 = 0 then 'authorization' else '' end as kept from pages")
def p05(spark, d):
    """Request headers that may be kept: authorization alone, in any case."""
    name = F.when(F.col("page_id") % 2 == 0, "Authorization").otherwise("Referer")
    headers = F.map_from_arrays(F.array(F.lit("Cookie"), name), F.array(F.lit("c"), F.lit("a")))
    kept = F.map_filter(headers, lambda k, v: F.lower(k) == "authorization")
    return ad.table(spark, d, "pages").select("page_id", F.array_join(F.transform(F.map_keys(kept), F.lower), ",").alias("kept"))


@query("p16_priority_titles", "select doc_id, coalesce(case when doc_id % 2 = 0 then source end, lang, '') as title from documents")
def p16(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang"), F.lit("")).alias("title"))


@query("p21_absolute_subchunks", "select l_orderkey as chunk, l_linenumber::bigint as sub, l_orderkey * 10000 + l_linenumber as ordinal, cast(floor((l_quantity + l_orderkey * 900e0) * 1000 + 0.5) as bigint) as s_ms from lineitem")
def p21(spark, d):
    """Times of sub-chunks moved to their chunk's start."""
    start = F.col("l_quantity") + F.col("l_orderkey") * F.lit(900.0)
    return ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("long").alias("sub"), (F.col("l_orderkey") * 10000 + F.col("l_linenumber")).alias("ordinal"), tm.millis(start).alias("s_ms"))


@query("p08_tagged_segments", ad.with_views(ad.EVENT_SEGMENTS) + "select media_id, ord, row_number() over (partition by media_id order by s, e, ord) - 1 as seg from ev where e > s and text <> ''")
def p08(spark, d):
    """Usable segments numbered within their bucket."""
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("s", "e", "ord")) - 1
    return ad.event_segments(spark, d).where("e > s and text <> ''").select("media_id", "ord", n.cast("long").alias("seg"))
