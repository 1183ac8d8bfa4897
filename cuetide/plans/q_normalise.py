"""Queries of the normaliser, the guard, windows about speech and the plans of retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.functions.times import millis
from cuetide.operators import intervals, normalise
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_intervals import _SPEECH_SUM
from cuetide.plans.q_runs import key_sql

EV, SP, SG = ad.EVENT_SEGMENTS, ad.SPEECH, ad.VIEWS
_MS = lambda c: f"cast(floor(({c}) * 1000 + 0.5) as bigint)"
_NO_WORDS = "array<struct<start:double,end:double,text:string,probability:double>>"


def _event_payloads(spark, d):
    """A payload per user, whose segments are events with a text of their own; every other one has a quality."""
    k = F.get_json_object("props", "$.k").cast("int")
    item = F.struct(
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"),
        (k / 10.0).alias("compressionRatio"), (k / 100.0).alias("no_speech_prob"), F.when(F.col("event_id") % 2 == 0, -k * 0.015).alias("avg_log_prob"),
    )
    lists = ad.table(spark, d, "events").where("value >= 0").groupBy(F.col("user_id").alias("chunk_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda v: v["x"]).alias("segments"))
    return lists.select("chunk_id", F.to_json(F.struct("segments")).alias("payload"))


_QUALITY = "q as (select user_id, event_id, value, event_type || ' ' || event_id as text, cast(json_extract_string(props, '$.k') as int) as k, row_number() over (partition by user_id order by event_id) - 1 as ord from events where value >= 0)"


@query("p14_segment_quality", f"with {_QUALITY} select user_id as chunk_id, event_id, {_MS('k / 10e0')} as compression_k, {_MS('k / 100e0')} as no_speech_k, case when event_id % 2 = 0 then {_MS('-k * 0.015e0')} end as logprob_k from q")
def p14(spark, d):
    """Raw segments read one by one, under any of the names."""
    raw = _event_payloads(spark, d).select("chunk_id", F.explode(F.from_json(F.get_json_object("payload", "$.segments"), "array<string>")).alias("raw"))
    q = normalise.quality_of(F.col("raw"))
    return raw.select("chunk_id", F.regexp_extract("raw", r'"text":"[a-z]+ (\d+)"', 1).cast("long").alias("event_id"), *[millis(q[c]).alias(f"{c}_k") for c in ("compression", "no_speech", "logprob")])


@query("p11_normalised_segments", f"with {_QUALITY}, f as (select *, min(value) over w as v0 from (select *, first_value(value) over (partition by user_id order by ord) as first_v from q) window w as (partition by user_id)) select user_id as chunk_id, ord, {_MS('value + user_id * 1000')} as s_ms, text from f where not (length({key_sql('text')}) >= 6 and k / 10e0 >= 8)")
def p11(spark, d):
    """Payloads with their quality under names that the reader of payloads knows, placed at their chunk's start."""
    rows = _event_payloads(spark, d).withColumn("payload", F.replace(F.replace("payload", F.lit("compressionRatio"), F.lit("compression_ratio")), F.lit("avg_log_prob"), F.lit("other")))
    chunks = rows.select("chunk_id", (F.col("chunk_id") * 1000.0).alias("start"), (F.col("chunk_id") * 1000.0 + 900).alias("end"))
    found, _ = normalise.normalise(rows, chunks)
    return found.select(F.col("media_id").alias("chunk_id"), "ord", millis(F.col("s")).alias("s_ms"), "text")


@query("p11_failed_payloads", "select p_partkey as chunk_id from part where p_size % 3 = 0")
def p11b(spark, d):
    """Text alone fails; nothing at all is empty; text with times is no failure."""
    k = F.col("p_size") % 3
    body = F.when(k == 0, '{"text": "said without times"}').when(k == 1, '{"text": "", "segments": []}').otherwise('{"text": "a word", "words": [{"word": "a", "start": 0, "end": 1}, {"word": "word", "start": 1, "end": 2}]}')
    rows = ad.table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), body.alias("payload"))
    chunks = rows.select("chunk_id", F.lit(0.0).alias("start"), F.lit(900.0).alias("end"))
    return normalise.normalise(rows, chunks)[1].select("chunk_id")


@query("p13_refined_segments", ad.with_views(EV, SP, SG) + f""", w as (select sp.media_id, sp.idx, min(sg.s) as lo, max(sg.e) as hi, count(*) as n from sp join sg on sg.media_id = sp.media_id and sg.e > sp.s + 0.05e0 and sg.s < sp.e - 0.05e0 group by 1, 2)
select sp.media_id, sp.idx, {_MS('coalesce(lo, s)')} as s_ms, {_MS('coalesce(hi, e)')} as e_ms, coalesce(n, 0) as words_n from sp left join w using (media_id, idx)""")
def p13(spark, d):
    """Views and clicks as a payload's own words, purchases and signups as its segments."""
    word = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("text"), F.lit(None).cast("double").alias("probability"))
    words = ad.views(spark, d).groupBy(F.col("media_id").alias("chunk_id")).agg(F.collect_list(word).alias("top"))
    segments = ad.speech(spark, d).select(F.col("media_id").alias("chunk_id"), "idx", "s", "e", F.array().cast(_NO_WORDS).alias("words"))
    found = normalise.refine_with_words(segments, words)
    return found.select(F.col("chunk_id").alias("media_id"), "idx", millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"), F.size("words").cast("long").alias("words_n"))


_EVIDENCE = f"""ev2 as (select so.*, exists (select 1 from sp where sp.media_id = so.media_id) as heard, media_id % 3 <> 0 as known, speech >= least(1e0, greatest(0.35e0, (e - s) * 0.45e0)) or speech / (e - s) >= 0.55e0 as strong from so),
vad as (select media_id, ord, compression >= 4 and no_speech >= 0.35e0 as vad from sg)"""


@query("f06_hallucination_guard", ad.with_views(EV, SP, SG, _SPEECH_SUM, _EVIDENCE) + "select media_id, ord from ev2 join vad using (media_id, ord) where not known or case when heard then strong else not vad end")
def f06(spark, d):
    """Segments without words: where speech is known, they need enough of it; where it is known to be none, their quality
    decides; where nothing is known they stay."""
    rows = ad.views(spark, d).withColumns({"words": F.lit(None).cast(_NO_WORDS), "logprob": F.lit(None).cast("double")})
    known = rows.where("media_id % 3 <> 0").select("media_id").distinct()
    return normalise.hallucination_guard(rows, ad.speech(spark, d), known, run_filters=False).select("media_id", "ord")


@query("iv06_clamped_words", ad.with_views(EV, SP, SG) + f""", pr as (select sg.media_id, sg.ord, sg.s, sg.e, sp.idx, greatest(sg.s, sp.s) as cs, least(sg.e, sp.e) as ce from sg join sp on sg.media_id = sp.media_id and sg.s < sp.e and sp.s < sg.e),
ag as (select media_id, ord, s, e, sum(ce - cs) as heard, min(cs) as cs, max(ce) as ce, arg_max(idx, struct_pack(d := ce - cs, i := -idx)) as idx from pr group by 1, 2, 3, 4),
kp as (select * from ag where not (heard / (e - s) < 0.7e0 and heard < least(0.2e0, greatest(0.03e0, (e - s) * 0.7e0))) and not (ce - cs < 0.1e0 and heard / (e - s) < 0.8e0)),
nw as (select *, cs - lag(ce) over w as gap, lag(idx) over w <> idx as moved from kp window w as (partition by media_id order by s, e, ord)),
pt as (select *, sum(case when gap > 10 or gap > 2 and moved then 1 else 0 end) over (partition by media_id order by s, e, ord) as part from nw)
select media_id, part::bigint as part, {_MS('min(cs)')} as s_ms, {_MS('max(ce)')} as e_ms, count(*) as words_n from pt group by 1, 2""")
def iv06(spark, d):
    """All views and clicks of a media as the words of one segment."""
    word = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("text"), F.lit(None).cast("double").alias("probability"))
    rows = ad.views(spark, d).groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "ord", word.alias("w")))), lambda x: x["w"]).alias("words")).withColumn("ord", F.lit(0).cast("long"))
    found = normalise.clamp_words(rows, ad.speech(spark, d))
    return found.select("media_id", F.col("part").cast("long").alias("part"), millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"), "words_n")


_R = lambda c: f"floor(({c}) * 1000 + 0.5) / 1000e0"


@query("iv09_speech_windows", "with recursive " + EV + ", " + SP + f""", md as (select distinct user_id as media_id, 8000e0 as d, user_id % 3 > 0 as known from events),
cl as (select sp.media_id, idx, {_R('greatest(0e0, s)')} as s, {_R('least(d, e)')} as e, d from sp join md using (media_id)), nb as (select *, row_number() over (partition by media_id order by s, e, idx) as n from cl where e > s),
fo as (select media_id, n, s as gs, e as ge, 0 as grp from nb where n = 1 union all
  select nb.media_id, nb.n, case when cut then nb.s else gs end, case when cut then nb.e else greatest(ge, nb.e) end, case when cut then grp + 1 else grp end
  from (select fo.*, nb.e - gs > 30 and ge > gs as cut from fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1) fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1),
co as (select media_id, grp, min(gs) as s, max(ge) as e from fo group by 1, 2), st as (select media_id, s, e, unnest(range(cast(ceil((e - s - 0.001e0) / 30e0) as bigint))) as k from co where e - s > 0.001e0),
pl as (select media_id, s + k * 30e0 as cs, least(e, s + (k + 1) * 30e0) as ce from st),
fx as (select media_id, k * 30e0 as cs, least(d, (k + 1) * 30e0) as ce from (select *, unnest(range(cast(ceil((d - 0.001e0) / 30e0) as bigint))) as k from md where not known and media_id not in (select media_id from nb)))
select media_id, {_MS('cs')} as core_s_ms, {_MS('ce')} as core_e_ms, {_MS('greatest(0e0, cs - 2)')} as s_ms, {_MS('least(8000e0, ce + 2)')} as e_ms from (select * from pl union all select * from fx)""")
def iv09(spark, d):
    """Uploads of 34 seconds with two of context: cores of thirty."""
    media = ad.table(spark, d, "events").select(F.col("user_id").alias("media_id")).distinct().withColumns({"duration": F.lit(8000.0), "known": F.col("media_id") % 3 > 0})
    found = normalise.speech_windows(ad.speech(spark, d).withColumn("ord", F.col("idx")), media, upload=34.0)
    return found.select("media_id", *[millis(F.col(c)).alias(f"{c}_ms") for c in ("core_s", "core_e", "s", "e")])


@query("iv14_context_overlap", """with sg as (select l_orderkey as media_id, l_linenumber::bigint as ord, (l_linenumber - 1) * 4e0 as s, l_linenumber * 4e0 as e from (select distinct l_orderkey, l_linenumber from lineitem)),
g as (select media_id, (ord - 1) // 3 as grp, min(s) as gs, max(e) as ge, count(*) as n from sg group by 1, 2), p as (select g.media_id, grp, ord, s >= gs and e <= ge as core, greatest(gs - e, s - ge, 0e0) as far, s, e from g join sg on sg.media_id = g.media_id and s < ge + 2 and e > gs - 2),
r as (select *, row_number() over w as n, sum(e - s) over (partition by media_id, grp order by not core, far, s, ord rows unbounded preceding) as used from p window w as (partition by media_id, grp order by not core, far, s, ord))
select media_id, grp, ord, core as is_core from r where core or (n <= 4 and used <= 16)""")
def iv14(spark, d):
    """Groups of three segments, with room for one more: the one before, or at the start the one after."""
    n = F.col("l_linenumber")
    segments = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), n.cast("long").alias("ord"), ((n - 1) * 4.0).alias("s"), (n * 4.0).alias("e")).distinct()
    groups = segments.groupBy("media_id", F.floor((F.col("ord") - 1) / 3).alias("grp")).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return normalise.context_overlap(groups, segments, most=4, seconds=12.0)


@query("ud08_filter_policies", "select p_partkey as id, case when c then 'external_vad_clip' when v then 'compatible_vad_filter' when n then 'speaches_native' when l then 'collected_external_vad' else 'direct' end as mode, n and not c and not l as activity_filter, not (c or v or n or l) as quality_filters, not c as run_filters from (select p_partkey, p_partkey % 2 = 0 as c, p_partkey // 2 % 2 = 0 as v, p_partkey // 4 % 2 = 0 as n, p_partkey // 8 % 2 = 0 as l from part)")
def ud08(spark, d):
    k = F.col("p_partkey")
    bit = lambda n: F.floor(k / n) % 2 == 0
    return ad.table(spark, d, "part").select(k.alias("id"), normalise.filter_policy(bit(1), bit(2), bit(4), bit(8)).alias("p")).select("id", "p.*")


@query("ud09_retry_plans", "select p_partkey as id, case when not m then null when w and c then 'without_clips' when not c and not v and x and z then 'with_service_vad' end as plan, p_size % 7 = 0 and p_size % 2 = 0 and v as recovery from (select p_partkey, p_size, p_partkey % 2 = 0 as m, p_partkey // 2 % 2 = 0 as c, p_partkey // 4 % 2 = 0 as w, p_partkey // 8 % 2 = 0 as v, p_partkey // 16 % 2 = 0 as x, p_partkey // 32 % 2 = 0 as z from part)")
def ud09(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    bit = lambda n: F.floor(k / n) % 2 == 0
    return ad.table(spark, d, "part").select(k.alias("id"), normalise.retry_plan(bit(1), bit(2), bit(4), bit(8), bit(16), bit(32)).alias("plan"), normalise.empty_recovery(size % 7 == 0, size % 2, bit(8)).alias("recovery"))


@query("a20_combined_attempts", ad.with_views(EV) + "select media_id, count(*) as first_n, count(*) filter (ord % 2 = 0) as second_n, count(*) as final_n, count(*) filter (ord % 2 = 0) as merged_n from ev where e > s + 0.01 group by 1")
def a20(spark, d):
    """The second attempt brings half of the first one's rows again, with other numbers; each has a text of its own."""
    first = intervals.valid(ad.event_segments(spark, d)).where("e > s + 0.01").withColumn("text", F.concat_ws("-", "text", F.col("ord").cast("string"))).select("media_id", "ord", "s", "e", "text")
    second = first.where("ord % 2 = 0").withColumn("ord", F.col("ord") + 10_000_000)
    return normalise.combine_attempts(first, second)[1].select("media_id", "first_n", "second_n", "final_n", "merged_n")
