"""Queries of recognition in attempts, over payloads made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.functions.times import millis
from cuetide.operators import attempts
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_intervals import GAPS, MS

EV, SP = ad.EVENT_SEGMENTS, ad.SPEECH

# Flags of a user's chunk, answers by form (2 * clips + detection), and which of a user's events each answer holds.
_UNROLLED = ad.with_views(EV, SP) + """, ch as (select u, u % 2 = 0 as clip, u % 3 = 0 as vad, u % 5 <> 0 as able, u % 4 <> 3 as known from (select distinct user_id as u from events)),
fm as (select u, form, (form >= 2 and u % 8 = 0) or (form = 1 and u % 7 = 0) or (form = 0 and u % 11 = 0) as failed from ch, range(4) f(form)),
pr as (select u * 4 + form as k, u, form, ord, s, e, text || ' ' || ord as text from fm join ev on ev.media_id = u where not failed and e > s and (ord % 4) >= form and not (form % 2 = 1 and u % 9 = 0)),
a1 as (select ch.*, 2 * clip::int + vad::int as f1, vad::int as f2, not x.failed as ok1, not y.failed as ok2 from ch join fm x on x.u = ch.u and x.form = 2 * clip::int + vad::int join fm y on y.u = ch.u and y.form = vad::int),
w as (select *, case when ok1 then f1 when clip and ok2 then f2 end as won, not ok1 and clip as asked2 from a1),
c1 as (select w.u as media_id, ord, s, e, text, case when ok1 then 1 else 2 end as attempt from w join pr on pr.u = w.u and pr.form = w.won),
em as (select w.*, won is not null and known and vad and not exists (select 1 from sp where sp.media_id = w.u) and not exists (select 1 from c1 where c1.media_id = w.u) as empty from w),
ks as (select sp.* from sp join em on em.u = sp.media_id and known and won is not null),
"""
_COVERED = GAPS.replace("from sp left join sg on sg.media_id", "from ks sp left join c1 sg on sg.media_id").replace(">= 0.08e0", "> 0")
_OUTCOME = _UNROLLED + _COVERED + """, ms as (select media_id from (select media_id, sum(e - s) as speech from ks where e - s >= 0.15e0 group by 1) t left join (select gp.media_id, sum(gp.e - gp.s) as missing from gp join ks k on k.media_id = gp.media_id and k.idx = gp.idx where k.e - k.s >= 0.15e0 group by 1) m using (media_id) where coalesce(missing, 0) >= least(1e0, greatest(0.15e0, speech * 0.25e0))),
pl as (select em.*, case when ms.media_id is null then null when clip and ok1 then 'without_clips' when not (clip and ok1) and not vad and u % 6 <> 1 and able then 'with_service_vad' end as plan from em left join ms on ms.media_id = em.u),
th as (select pl.*, case plan when 'without_clips' then vad::int when 'with_service_vad' then 1 end as f3, 1 + asked2::int + empty::int as made from pl)
"""


def _recorded(spark, d):
    """(chunks, recorded, speech)."""
    events = ad.event_segments(spark, d)
    u = F.col("chunk_id")
    users = events.select(F.col("media_id").alias("chunk_id")).distinct()
    chunks = users.withColumns({"start": F.lit(0.0), "end": F.lit(1e6), "clip": u % 2 == 0, "vad": u % 3 == 0, "precheck": u % 6 != 1, "vad_supported": u % 5 != 0, "known": u % 4 != 3})
    forms = users.withColumn("form", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    f = F.col("form")
    forms = forms.withColumn("failed", ((f >= 2) & (u % 8 == 0)) | ((f == 1) & (u % 7 == 0)) | ((f == 0) & (u % 11 == 0)))
    item = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.concat_ws(" ", "text", F.col("ord").cast("string")).alias("text"))
    lists = events.where("e > s").groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))).alias("all"))
    held = forms.join(lists, u == F.col("media_id"), "left")
    # Positions in a list are not the events' numbers, so an item keeps its number in its text.
    some = F.when((f % 2 == 1) & (u % 9 == 0), F.array().cast(lists.schema["all"].dataType)).otherwise(F.filter("all", lambda v: F.pmod(v["ord"], F.lit(4)) >= f))
    payload = F.to_json(F.struct(F.transform(some, lambda v: v["x"]).alias("segments")))
    recorded = held.select("chunk_id", (f >= 2).alias("clip"), (f % 2 == 1).alias("vad"), "failed", payload.alias("payload"))
    return chunks, recorded, ad.speech(spark, d)


@query("ud01_transcripts", _OUTCOME + f""", fresh as (select th.u as media_id, pr.ord, pr.s, pr.e, pr.text, made + 1 as attempt from th join pr on pr.u = th.u and pr.form = th.f3 where exists (select 1 from gp where gp.media_id = th.u and least(pr.e, gp.e + 0.2e0) - greatest(pr.s, gp.s - 0.2e0) > 0 and least(pr.e, gp.e + 0.2e0) - greatest(pr.s, gp.s - 0.2e0) >= least(0.35e0, greatest(0.08e0, (pr.e - pr.s) * 0.25e0))))
select media_id, {MS('s')} as s_ms, {MS('e')} as e_ms, text, attempt from (select * from c1 union all select * from fresh union all select em.u, ord, s, e, text, case when ok1 then 2 else 3 end from em join pr on pr.u = em.u and pr.form = 0 where empty and e - s <= 8)""")
def ud01(spark, d):
    """Recorded answers to segments, with the request that brought each."""
    rows, _ = attempts.transcribe(*_recorded(spark, d), quality=False, run_filters=False)
    return rows.select("media_id", millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"), "text", "attempt")


@query("ud01_requests", _OUTCOME + "select u as chunk_id, made + (f3 is not null)::int as requests, coalesce(plan, case when empty then 'empty' when asked2 then 'without_clips_refused' end) as plan, won is null as failed from th")
def ud01_requests(spark, d):
    """How many requests each chunk took, and why the last."""
    return attempts.transcribe(*_recorded(spark, d), quality=False, run_filters=False)[1]
