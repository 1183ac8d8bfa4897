"""Queries of the run filters, retention and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.functions import text as tx
from cuetide.functions.times import millis
from cuetide.operators import retention, runs, summary
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query

EV, CU = ad.EVENT_SEGMENTS, ad.DOC_CUES
_PUNCT = tx.PUNCT.replace("'", "''")
_WS = tx.WS


def key_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), '[{_WS}{_PUNCT}]+', '', 'g')"


def clean_sql(c: str) -> str:
    body = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g')"
    for name, char in tx.ENTITIES:
        body = f"replace({body}, '{name}', '{char}')"
    return f"regexp_replace(regexp_replace({body}, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g')"


_WIDE = tx.PUNCT_WIDE.replace("'", "''")


def kind_sql(c: str, source: str, name: str) -> str:
    """A table name of source's columns with kind: information_kind(c). Repeated units are found by repeating them, since
    this SQL's patterns know no back references."""
    unit = lambda least: " or ".join(f"(n >= {least * u} and n % {u} = 0 and repeat(substr(k, 1, {u}), (n // {u})::bigint) = k)" for u in (1, 2, 3, 4))
    return f"""{name} as (select * exclude (raw, k, n), case when raw = '' then null when {key_sql('raw')} = '' then 'punctuation'
    when n > 0 and not regexp_matches(k, '\\p{{N}}') and (case when regexp_matches(k, '^[a-z]+$') then (n <= 4 and not regexp_matches(k, '[aeiouy]')) or {unit(3)} else n = 1 or {unit(2)} end or (n >= 8 and len(list_distinct(string_split(k, ''))) / n <= 0.25)) then 'low_information' end as kind
  from (select *, length(k) as n from (select *, regexp_replace(lower(raw), '[{_WS}{_WIDE}]+', '', 'g') as k from (select *, {clean_sql(c)} as raw from {source}))))"""


def eligible_sql(k: str) -> str:
    return f"(length({k}) >= 6 or (length({k}) >= 3 and regexp_matches({k}, '[^\\p{{Latin}}\\p{{N}}_]')))"


_REPEATED = f"""kd as (select *, {key_sql('text')} as k from ev),
fl as (select *, sum(new) over (partition by media_id order by s, e, ord) as island from (
  select *, case when lag(k) over (partition by media_id order by s, e, ord) is distinct from k or k = '' then 1 else 0 end as new from kd)),
rn as (select *, count(*) over w as n, sum(greatest(0e0, e - s)) over w as total from fl window w as (partition by media_id, island)),
a01 as (select * from rn where not ({eligible_sql('k')} and n >= 4 and total >= 6))"""


@query("a01_repeated_runs", ad.with_views(EV, _REPEATED) + "select media_id, ord, text from a01")
def a01(spark, d):
    return runs.drop_repeated_runs(ad.event_segments(spark, d)).select("media_id", "ord", "text")


@query("a02_spread_repeats", ad.with_views(EV, f"""kd as (select *, {key_sql('text')} as k, e - s >= 3 and no_speech >= 0.6e0 as odd from ev),
ag as (select media_id, k, count(*) as n, arg_max(e, struct_pack(s := s, o := ord)) - min(s) as span, sum(case when odd then 1 else 0 end) as od, sum(case when odd or no_speech >= 0.9e0 then 1 else 0 end) as wk from kd where {eligible_sql('k')} group by 1, 2),
bad as (select * from ag where span >= 60 and n >= 2 and ((n >= 8 and span >= 300) or (n >= 5 and span >= 600 and wk >= 2 and wk / n >= 0.25) or (od >= 2 and od / n >= 0.5)))""") + "select media_id, ord from kd where not exists (select 1 from bad where bad.media_id = kd.media_id and bad.k = kd.k)")
def a02(spark, d):
    odd = (F.col("e") - F.col("s") >= 3) & (F.col("no_speech") >= 0.6)
    return runs.drop_spread_repeats(ad.event_segments(spark, d), odd, F.col("no_speech") >= 0.9).select("media_id", "ord")


@query("a03_low_information_runs", ad.with_views(CU, "th as (select media_id, ord, s, e, case when media_id % 3 = 0 then regexp_replace(text, '[\\p{L}\\p{N}]{3,}', '', 'g') else text end as text from cu)", kind_sql("text", "th", "kd")) + """,
rn as (select *, kind is not distinct from 'low_information' as single, sum(case when kind is null then 1 else 0 end) over (partition by media_id order by s, e, ord) as island from kd),
hd as (select *, min(case when single then 1 else 0 end) over (partition by media_id, island, kind is null order by s, e, ord rows unbounded preceding) as head from rn),
kp as (select * from hd where (kind is null and not single) or (kind is not null and head = 0)),
ow as (select *, count(*) over w as n, min(case when kind = 'punctuation' then 1 else 0 end) over w = 1 as marks, arg_min(s, struct_pack(s := s, e := e, o := ord)) over w as first_s, arg_max(e, struct_pack(s := s, e := e, o := ord)) over w as last_e from kp window w as (partition by media_id, island, kind is null))
select media_id, ord from ow where kind is null or not case when marks then n >= 3 and greatest(0, last_e - first_s) >= 2 else n >= 5 and greatest(0, last_e - first_s) >= 10 end""")
def a03(spark, d):
    """Cues of documents, of which every third is thinned to marks, so that runs occur."""
    cues = ad.doc_cues(spark, d).withColumn("text", F.when(F.col("media_id") % 3 == 0, F.regexp_replace("text", r"[\p{L}\p{N}]{3,}", "")).otherwise(F.col("text")))
    return runs.drop_low_information(cues).select("media_id", "ord")


@query("a04_repeated_phrases", ad.with_views(EV) + "select media_id, ord, e - s >= 8 and no_speech >= 0.5e0 as repeated from ev")
def a04(spark, d):
    """One phrase, said once or five times."""
    said = F.when(F.col("no_speech") >= 0.5, F.concat_ws(", ", *[F.col("text")] * 5)).otherwise(F.col("text"))
    return ad.event_segments(spark, d).select("media_id", "ord", tx.is_repeated_phrase(said, F.col("e") - F.col("s")).alias("repeated"))


@query("a06_variant_counts", "select user_id as group_id, count(*) filter (event_type = 'view') as audio, count(*) filter (event_type = 'click') as video, count(*) filter (event_type in ('signup', 'error')) as manifests, count(*) as variants from events group by 1")
def a06(spark, d):
    """Variants counted by role."""
    kinds = F.col("event_type")
    return ad.table(spark, d, "events").groupBy(F.col("user_id").alias("group_id")).agg(F.count_if(kinds == "view").alias("audio"), F.count_if(kinds == "click").alias("video"), F.count_if(kinds.isin("signup", "error")).alias("manifests"), F.count(F.lit(1)).alias("variants"))


_STATUS = """st as (select o_custkey as job_id, case o_orderstatus when 'F' then 'completed' when 'O' then case when o_orderkey % 7 = 0 then 'failed' else 'asr' end else 'completed_with_warnings' end as stage,
  o_orderkey % 5 // 4 as af, o_orderkey % 4 as tf from orders)"""


def _status(spark, d):
    o = F.col("o_orderstatus")
    stage = F.when(o == "F", "completed").when(o == "O", F.when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("asr")).otherwise("completed_with_warnings")
    return ad.table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), stage.alias("stage"), F.floor(F.col("o_orderkey") % 5 / 4).cast("long").alias("asr_failures"), (F.col("o_orderkey") % 4).alias("translation_failures"))


_COUNTERS = """select job_id, count(*) as chunks, count(*) filter (stage in ('completed', 'completed_with_warnings', 'failed')) as done, count(*) filter (stage = 'failed') as failed,
  count(*) filter (stage = 'asr') as recognising, count(*) filter (stage = 'translation') as translating, count(*) filter (stage <> 'failed' and af > 0) as partial,
  cast(sum(case when stage <> 'failed' then af else 0 end) as bigint) as lost_audio, cast(sum(case when stage = 'completed_with_warnings' then tf else 0 end) as bigint) as lost_lines from st group by 1"""


@query("a09_job_counters", ad.with_views(_STATUS) + f"select job_id, chunks, done, failed, recognising, translating, partial, cast(floor(done * 1000 / chunks + 0.5) as bigint) as permille from ({_COUNTERS})")
def a09(spark, d):
    found = summary.job_counters(_status(spark, d))
    return found.select("job_id", "chunks", "done", "failed", "recognising", "translating", "partial", F.floor(F.col("percent") * 10 + 0.5).cast("long").alias("permille"))


@query("a12_final_stage", ad.with_views(_STATUS) + f"select job_id, lost_audio, lost_lines, case when failed > 0 or partial > 0 or lost_lines > 0 then 'completed_with_warnings' else 'completed' end as final_stage from ({_COUNTERS})")
def a12(spark, d):
    return summary.job_counters(_status(spark, d)).select("job_id", "lost_audio", "lost_lines", "final_stage")


@query("a11_coverage_warning", ad.with_views(ad.TURNS) + ", m as (select media_id, max(e) as last, media_id % 13 * 100e0 as expected from tn group by 1) select media_id, case when expected < 300 then 'ok' when coalesce(last, 0) <= 0 then 'none' when expected - last > 120 and last < expected * 0.75e0 then 'short' else 'ok' end as warning from m")
def a11(spark, d):
    ends = ad.turns(spark, d).groupBy("media_id").agg(F.max("e").alias("last"))
    return ends.select("media_id", summary.coverage_warning(F.col("last"), F.col("media_id") % 13 * F.lit(100.0)).alias("warning"))


@query("a13_stage_counts", ad.with_views(EV, _REPEATED) + "select media_id, count(*) as before_n, count(*) - count(*) filter (keep) as dropped_n from (select kd.media_id, a01.ord is not null as keep from kd left join a01 using (media_id, ord)) group by 1")
def a13(spark, d):
    """Rows before a filter and rows it dropped, by media."""
    ev = ad.event_segments(spark, d)
    kept = runs.drop_repeated_runs(ev).groupBy("media_id").agg(F.count(F.lit(1)).alias("_kept"))
    return ev.groupBy("media_id").agg(F.count(F.lit(1)).alias("before_n")).join(kept, "media_id", "left").select("media_id", "before_n", (F.col("before_n") - F.coalesce("_kept", F.lit(0))).alias("dropped_n"))


@query("a14_repeated_keys", ad.with_views(EV) + f"select media_id, {key_sql('text')} as key, count(*) as n from ev where length({key_sql('text')}) >= 6 group by 1, 2 having count(*) >= 2 and max(e) - min(s) >= 6")
def a14(spark, d):
    return runs.repeated_keys(ad.event_segments(spark, d), tx.repeat_key(F.col("text"))).select("media_id", "key", "n")


@query("a15_running_durations", ad.with_views(ad.TURNS) + "select media_id, ord, cast(floor(s * 1000 + 0.5) as bigint) as s_ms, cast(floor(e * 1000 + 0.5) as bigint) as e_ms from tn")
def a15(spark, d):
    """Starts and ends as sums of the durations before."""
    return ad.turns(spark, d).select("media_id", F.col("ord").cast("long"), millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"))


@query("a16_duration_evidence", "select user_id as media_id, arg_max(event_type, struct_pack(k := case event_type when 'purchase' then 4 when 'signup' then 3 when 'view' then 2 else 1 end, v := value, i := event_id)) as evidence, count(*) as n from events group by 1")
def a16(spark, d):
    """The strongest evidence of a duration: by kind, then by seconds."""
    t = F.col("event_type")
    strength = F.when(t == "purchase", 4).when(t == "signup", 3).when(t == "view", 2).otherwise(1)
    return ad.table(spark, d, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.max_by("event_type", F.struct(strength, "value", "event_id")).alias("evidence"), F.count(F.lit(1)).alias("n"))


@query("a17_retry_counts", ad.with_views(_STATUS) + "select stage, count(distinct job_id) as jobs, count(*) filter (af > 0) as retryable from st group by 1")
def a17(spark, d):
    return _status(spark, d).groupBy("stage").agg(F.count_distinct("job_id").alias("jobs"), F.count_if(F.col("asr_failures") > 0).alias("retryable"))


@query("so02_dropped_rows", ad.with_views(EV, _REPEATED) + """, af as (select media_id, floor(s * 1000 + 0.5) as a, floor(e * 1000 + 0.5) as b, text, count(*) as have from a01 group by 1, 2, 3, 4),
bf as (select *, floor(s * 1000 + 0.5) as a, floor(e * 1000 + 0.5) as b, row_number() over (partition by media_id, floor(s * 1000 + 0.5), floor(e * 1000 + 0.5), text order by ord) as nth from ev)
select bf.media_id, bf.ord from bf left join af using (media_id, a, b, text) where coalesce(have, 0) < nth""")
def so02(spark, d):
    ev = ad.event_segments(spark, d)
    return runs.dropped_rows(ev, runs.drop_repeated_runs(ev)).select("media_id", "ord")


@query("so03_distinct_urls", "with u as (select page_id // 4 as g, page_id, regexp_replace(url, '[?#].*$', '') as u from pages where regexp_matches(url, '^https?://')), f as (select g, u, min(page_id) as p from u group by 1, 2) select g, string_agg(u, ' ' order by p) as urls, count(*) as n from f group by 1")
def so03(spark, d):
    """URLs of a list without repeats, in order."""
    rows = ad.table(spark, d, "pages").where(F.col("url").rlike("^https?://")).select(F.floor(F.col("page_id") / 4).alias("g"), "page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"))
    lists = rows.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "u"))), lambda x: x["u"]).alias("a"))
    return lists.select("g", F.array_join(F.array_distinct("a"), " ").alias("urls"), F.size(F.array_distinct("a")).cast("long").alias("n"))


@query("so04_distinct_on_index", "select l_suppkey as job_id, l_linenumber::bigint as idx, min(l_orderkey) as first_order from lineitem group by 1, 2")
def so04(spark, d):
    """The first row for each chunk number of a job."""
    rows = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("idx"), F.col("l_orderkey").alias("first_order"))
    return retention.keep_best(rows, ["job_id", "idx"], [F.col("first_order")], 1)


@query("so05_upsert", "select user_id as tab, event_type as kind, arg_max(props, event_id) filter (trim(props) <> '') as props, arg_max(value, event_id) filter (value > 0) as size, min(event_id) as first_seq, max(event_id) as last_seq, count(*) as events from events group by 1, 2")
def so05(spark, d):
    rows = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), F.col("event_type").alias("kind"), "event_id", "props", F.col("value").alias("size"))
    return retention.upsert(rows, ["tab", "kind"], "event_id", texts=["props"], numbers=["size"])


@query("so06_exactly_once", "select distinct l_orderkey, l_suppkey, l_linenumber from lineitem")
def so06(spark, d):
    return ad.table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_suppkey", "l_linenumber")


@query("so07_distinct_resources", "select distinct l_partkey, l_suppkey from lineitem")
def so07(spark, d):
    """Resources to fetch, each once."""
    return ad.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


_NOW = 86400 * 1050


@query("wf02_prune_cache", ad.with_views(ad.CACHE_ENTRIES) + f""", r as (select *, row_number() over (partition by owner order by updated desc, id) as rnk from ce),
o as (select *, (updated > 0 and updated < {_NOW} - 30 * 86400) or rnk > 80 as gone from r),
z as (select *, sum(case when not gone then bytes else 0 end) over (partition by owner) as total, coalesce(sum(case when not gone and not protected then bytes else 0 end) over (partition by owner order by updated, id desc rows between unbounded preceding and 1 preceding), 0) as freed from o)
select id, owner, protected or not (gone or total - freed > 262144) as kept from z""")
def wf02(spark, d):
    return retention.prune_cache(ad.cache_entries(spark, d), F.lit(_NOW), ["owner"], most_bytes=262144).select("id", "owner", "kept")


@query("wf03_prune_audio", """with au as (select l_suppkey as owner, l_orderkey * 10 + l_linenumber as url, epoch(l_shipdate)::bigint as cached, cast(l_quantity * 1000000 as bigint) as bytes, l_linestatus = 'O' and l_linenumber = 1 as running from lineitem),
q as (select *, not running and cached > 0 and 883612800 - cached > 36 * 3600 * 400 as old from au),
z as (select *, sum(case when not old and not running then bytes else 0 end) over (partition by owner) as total, coalesce(sum(case when not old and not running then bytes else 0 end) over (partition by owner order by cached, url rows between unbounded preceding and 1 preceding), 0) as freed from q)
select owner, url, running or (not old and total - freed <= 2147483648) as kept from z""")
def wf03(spark, d):
    rows = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("url"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("cached"), (F.col("l_quantity") * 1000000).cast("long").alias("bytes"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)).alias("running"))
    return retention.prune_audio(rows, F.lit(883612800), ["owner"], hours=36 * 400).select("owner", "url", "kept")
