"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.functions.times import millis
from cuetide.operators import intervals as iv
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query

MS = lambda c: f"cast(floor(({c}) * 1000 + 0.5) as bigint)"
EV, SP, SG, CU = ad.EVENT_SEGMENTS, ad.SPEECH, ad.VIEWS, ad.DOC_CUES


def _ms(df, *more):
    return df.select("media_id", *more, millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"))


def _union_sql(source: str, keys: str = "media_id", gap: float = 0.15) -> str:
    return f"""isl as (select *, sum(case when reach is null or s > reach + {gap}e0 then 1 else 0 end) over (partition by {keys} order by s, e, ord) as island from (
  select *, max(e) over (partition by {keys} order by s, e, ord rows between unbounded preceding and 1 preceding) as reach from {source} where e > s)),
un as (select {keys}, min(s) as s, max(e) as e, count(*) as members from isl group by {keys}, island)"""


@query("iv01_interval_union", ad.with_views(EV, _union_sql("ev")) + f"select media_id, members, {MS('s')} as s_ms, {MS('e')} as e_ms from un")
def iv01(spark, d):
    return _ms(iv.union(ad.event_segments(spark, d)), "members")


@query("iv02_normalise_intervals", ad.with_views(EV) + f"select media_id, count(*) as n, string_agg({MS('s')} || '-' || {MS('e')}, ',' order by s, e) as spans from ev where e > s group by 1")
def iv02(spark, d):
    spans = ad.event_segments(spark, d).groupBy("media_id").agg(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).alias("a"))
    clean = iv.normalised_array(F.col("a"))
    text = F.transform(clean, lambda x: F.concat_ws("-", millis(x["start"]).cast("string"), millis(x["end"]).cast("string")))
    return spans.select("media_id", F.size(clean).cast("long").alias("n"), F.array_join(text, ",").alias("spans")).where("n > 0")


@query("iv08_overlapped_windows", f"""with w as (select doc_id as media_id, n_chars / 10e0 as d, unnest(range(cast(ceil((n_chars / 10e0 - 0.001e0) / 896e0) as bigint))) as idx from documents where n_chars / 10e0 > 0.001e0)
select media_id, idx, {MS('idx * 896e0')} as core_s_ms, {MS('least(d, (idx + 1) * 896e0)')} as core_e_ms, {MS('greatest(0e0, idx * 896e0 - 2)')} as s_ms, {MS('least(d, least(d, (idx + 1) * 896e0) + 2)')} as e_ms from w""")
def iv08(spark, d):
    docs = ad.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), (F.col("n_chars") / F.lit(10.0)).alias("d"))
    found = iv.fixed_windows(docs, F.col("d"))
    return found.select("media_id", F.col("idx").cast("long").alias("idx"), millis(F.col("core_s")).alias("core_s_ms"), millis(F.col("core_e")).alias("core_e_ms"), millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"))


_R = lambda c: f"floor(({c}) * 1000 + 0.5) / 1000e0"


@query("iv11_pad_intervals", ad.with_views(EV, f"""r as (select media_id, ord, s, e from (select media_id, ord, {_R('greatest(0e0, s)')} as s, {_R('e')} as e from ev) where e > s),
g as (select *, s - lag(e) over o as b, lead(s) over o - e as a from r window o as (partition by media_id order by s, e, ord)),
p as (select media_id, ord, {_R("greatest(0e0, s - case when b is null or b >= 0.8e0 then 0.4e0 else greatest(0e0, b / 2) end)")} as s,
  {_R("e + case when a is null or a >= 0.8e0 then 0.4e0 else greatest(0e0, a / 2) end")} as e from g)""", _union_sql("p")) + f"select media_id, members, {MS('s')} as s_ms, {MS('e')} as e_ms from un")
def iv11(spark, d):
    return _ms(iv.pad(ad.event_segments(spark, d)), "members")


@query("iv12_intersect_intervals", ad.with_views(EV) + f"select media_id, ord, {MS('greatest(s, 100e0)')} as s_ms, {MS('least(e, 400e0)')} as e_ms from ev where least(e, 400e0) > greatest(s, 100e0)")
def iv12(spark, d):
    return _ms(iv.clip(ad.event_segments(spark, d), F.lit(100.0), F.lit(400.0)), "ord")


@query("iv15_clip_timeline", ad.with_views(CU) + f"select media_id, ord, {MS('s')} as s_ms, {MS('least(e, 41e0)')} as e_ms from cu where s < 41")
def iv15(spark, d):
    """Cues of a timeline cut at a requested duration."""
    return _ms(ad.doc_cues(spark, d).where("s < 41").withColumn("e", F.least(F.col("e"), F.lit(41.0))), "ord")


@query("iv18_translation_buckets", ad.with_views(CU) + "select media_id, cast(floor((s + 0.001e0) / 900e0) as bigint) as bucket, count(*) as cues, cast(floor(least((floor((min(s) + 0.001e0) / 900e0) + 1) * 900e0, max(e)) * 1000 + 0.5) as bigint) as end_ms from cu group by 1, 2")
def iv18(spark, d):
    from cuetide.operators.windows import translation_buckets

    return translation_buckets(ad.doc_cues(spark, d)).select("media_id", "bucket", "cues", millis(F.col("end")).alias("end_ms"))


@query("iv19_contiguous_sequences", "select l_orderkey as group_id, count(*) as n, count(distinct l_linenumber) = count(*) and max(l_linenumber) - min(l_linenumber) + 1 = count(*) or count(*) < 2 as contiguous from lineitem where l_quantity > 10 group by 1")
def iv19(spark, d):
    """Whether numbered fragments have gaps or repeats; fewer than two pass."""
    items = ad.table(spark, d, "lineitem").where("l_quantity > 10")
    n = F.count(F.lit(1))
    fits = (n < 2) | ((F.count_distinct("l_linenumber") == n) & (F.max("l_linenumber") - F.min("l_linenumber") + 1 == n))
    return items.groupBy(F.col("l_orderkey").alias("group_id")).agg(n.alias("n"), fits.alias("contiguous"))


@query("sf20_overlap_seconds", ad.with_views(EV, SP, SG) + f"select sg.media_id, sg.ord, sp.idx, {MS('greatest(0e0, least(sg.e, sp.e) - greatest(sg.s, sp.s))')} as overlap_ms from sg join sp on sg.media_id = sp.media_id and sg.s < sp.e and sp.s < sg.e")
def sf20(spark, d):
    from cuetide.functions.times import overlap

    other = ad.speech(spark, d).select("media_id", "idx", F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = iv.overlap_join(ad.views(spark, d), other, bucket=30.0)
    return pairs.select("media_id", "ord", "idx", millis(overlap(F.col("s"), F.col("e"), F.col("rs"), F.col("re"))).alias("overlap_ms"))


@query("j01_words_in_window", ad.with_views(EV, SG, SP) + "select sp.media_id, sp.idx, count(*) as words from sp join sg on sg.media_id = sp.media_id and sg.e > sp.s + 0.05e0 and sg.s < sp.e - 0.05e0 group by 1, 2")
def j01(spark, d):
    """Words overlapping a segment by more than a margin."""
    words = ad.views(spark, d).select("media_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = iv.overlap_join(ad.speech(spark, d), words, slack=-0.05)
    return pairs.groupBy("media_id", "idx").agg(F.count(F.lit(1)).alias("words"))


_SPEECH_SUM = """so as (select sg.media_id, sg.ord, sg.s, sg.e, sum(case when sp.s is null then 0e0 else greatest(0e0, least(sg.e, sp.e + 0.05e0) - greatest(sg.s, sp.s - 0.05e0)) end) as speech
  from sg left join sp on sg.media_id = sp.media_id and sg.s < sp.e + 0.05e0 and sp.s - 0.05e0 < sg.e group by 1, 2, 3, 4)"""


@query("j02_speech_overlap", ad.with_views(EV, SP, SG, _SPEECH_SUM) + f"select media_id, ord, {MS('speech')} as speech_ms, speech >= least(1e0, greatest(0.35e0, (e - s) * 0.45e0)) or speech / (e - s) >= 0.55e0 as strong from so")
def j02(spark, d):
    found = iv.speech_overlap(ad.views(spark, d), ad.speech(spark, d))
    return found.select("media_id", "ord", millis(F.col("speech")).alias("speech_ms"), iv.strong_speech(F.col("speech"), F.col("e") - F.col("s")).alias("strong"))


@query("j03_speech_semi_join", ad.with_views(EV, SP, SG) + "select media_id, ord from sg where exists (select 1 from sp where sp.media_id = sg.media_id and sg.s < sp.e and sp.s < sg.e)")
def j03(spark, d):
    other = ad.speech(spark, d).select("media_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    return iv.overlap_join(ad.views(spark, d), other, how="left_semi").select("media_id", "ord")


@query("j04_nearest_speech", ad.with_views(EV, SP, SG) + f"select media_id, ord, {MS('s - (select max(sp.e) from sp where sp.media_id = sg.media_id and sp.e <= sg.s)')} as before_ms, {MS('(select min(sp.s) from sp where sp.media_id = sg.media_id and sp.s >= sg.e) - e')} as after_ms from sg")
def j04(spark, d):
    found = iv.nearest_speech(ad.views(spark, d), ad.speech(spark, d))
    return found.select("media_id", "ord", millis(F.col("silence_before")).alias("before_ms"), millis(F.col("silence_after")).alias("after_ms"))


@query("j05_best_interval", ad.with_views(EV, SP, SG) + """, pr as (select sg.media_id, sg.ord, sp.idx, row_number() over (partition by sg.media_id, sg.ord order by least(sg.e, sp.e) - greatest(sg.s, sp.s) desc, sp.idx) as nth
  from sg join sp on sg.media_id = sp.media_id and sg.s < sp.e and sp.s < sg.e where least(sg.e, sp.e) > greatest(sg.s, sp.s))
select sg.media_id, sg.ord, coalesce(pr.idx, -1) as interval_idx from sg left join pr on pr.media_id = sg.media_id and pr.ord = sg.ord and nth = 1""")
def j05(spark, d):
    return iv.best_interval(ad.views(spark, d), ad.speech(spark, d)).select("media_id", "ord", F.col("interval").cast("long").alias("interval_idx"))


GAPS = """spn as (select sp.media_id, sp.idx, sp.s, sp.e, case when sg.s is not null then greatest(sp.s, sg.s - 0.35e0) end as cs, case when sg.s is not null then least(sp.e, sg.e + 0.35e0) end as ce
  from sp left join sg on sg.media_id = sp.media_id and sp.s < sg.e + 0.35e0 and sg.s - 0.35e0 < sp.e),
rc as (select *, coalesce(max(ce) over (partition by media_id, idx order by cs, ce rows between unbounded preceding and 1 preceding), s) as reach from spn),
gp as (select media_id, idx, s, e from (
  select media_id, idx, reach as s, cs as e from rc where cs > reach union all
  select media_id, idx, coalesce(max(ce), min(s)) as s, e from spn group by media_id, idx, e having coalesce(max(ce), min(s)) < e) where e - s >= 0.08e0)"""


@query("j11_uncovered_speech", ad.with_views(EV, SP, SG, GAPS) + f"select media_id, idx, {MS('s')} as s_ms, {MS('e')} as e_ms from gp")
def j11(spark, d):
    return _ms(iv.uncovered(ad.speech(spark, d), ad.views(spark, d)), "idx")


@query("j16_cue_at_time", ad.with_views(CU) + """, pt as (select doc_id as media_id, i as point_id, i * 2.75e0 as t from documents, range(6) r(i)),
ls as (select media_id, max(ord) as last from cu group by 1),
ht as (select pt.media_id, pt.point_id, cu.ord, row_number() over (partition by pt.media_id, pt.point_id order by cu.s desc, cu.ord desc) as nth from pt join cu using (media_id) join ls using (media_id)
  where t >= s and (t < e or (cu.ord = last and t <= e)))
select pt.media_id, pt.point_id, coalesce(ht.ord, -1) as cue from pt left join ht on ht.media_id = pt.media_id and ht.point_id = pt.point_id and nth = 1""")
def j16(spark, d):
    points = ad.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("point_id")).withColumn("t", F.col("point_id") * F.lit(2.75))
    return iv.point_lookup(points, ad.doc_cues(spark, d)).select("media_id", "point_id", "cue")


@query("j10_restore_timeline", """with pc as (select user_id as map_id, row_number() over (partition by user_id order by event_id) - 1 as n, epoch_us(ts) / 1e9 as src from events where event_type = 'purchase'),
pieces as (select map_id, n * 10e0 as out_s, n * 10e0 + 8 as out_e, src as src_s, src + 16 as src_e from pc),
pts as (select user_id as map_id, event_id as point_id, value as t from events where event_type = 'view'),
j as (select p.map_id, p.point_id, p.t, out_s, out_e, src_s, src_e, row_number() over (partition by p.map_id, p.point_id order by (out_e > t) desc, case when out_e > t then out_s else -out_s end) as nth from pts p left join pieces using (map_id))
select map_id, point_id, cast(floor(coalesce(src_s + (t - out_s) * ((src_e - src_s) / (out_e - out_s)), t) * 1000 + 0.5) as bigint) as source_ms from j where nth = 1""")
def j10(spark, d):
    from pyspark.sql import Window

    events = ad.table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e9)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    pieces = events.where("event_type = 'purchase'").select(F.col("user_id").alias("map_id"), (n * F.lit(10.0)).alias("out_s"), at.alias("src_s")).withColumns({"out_e": F.col("out_s") + 8, "src_e": F.col("src_s") + 16})
    points = events.where("event_type = 'view'").select(F.col("user_id").alias("map_id"), F.col("event_id").alias("point_id"), F.col("value").alias("t"))
    return iv.as_of_piece(points, pieces).select("map_id", "point_id", millis(F.col("source_t")).alias("source_ms"))


@query("a10_speech_coverage", ad.with_views(EV, SP, SG, GAPS.replace(">= 0.08e0", "> 0")) + f""", sig as (select * from sp where e - s >= 0.15e0), tot as (select media_id, sum(e - s) as speech, count(*) as n from sig group by 1),
unc as (select media_id, sum(gp.e - gp.s) as missing from gp join sig using (media_id, idx) group by 1)
select media_id, n, {MS('speech')} as speech_ms, {MS('coalesce(missing, 0)')} as missing_ms, coalesce(missing, 0) >= least(1e0, greatest(0.15e0, speech * 0.25e0)) as retry from tot left join unc using (media_id)""")
def a10(spark, d):
    from cuetide.operators.summary import speech_coverage

    found = speech_coverage(ad.speech(spark, d), ad.views(spark, d))
    return found.select("media_id", "n", millis(F.col("speech")).alias("speech_ms"), millis(F.col("missing")).alias("missing_ms"), "retry")
