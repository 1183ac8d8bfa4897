"""Queries of folds, guards and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.functions import text as tx
from cuetide.functions.times import millis
from cuetide.operators import folds, guards, speech_quality
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_runs import clean_sql, key_sql, kind_sql

EV, SP, SG = ad.EVENT_SEGMENTS, ad.SPEECH, ad.VIEWS
_MS = lambda c: f"cast(floor(({c}) * 1000 + 0.5) as bigint)"


def _numbered(source: str) -> str:
    return f"nb as (select *, row_number() over (partition by media_id order by s, e, ord) as n from {source})"


@query("iv03_merge_duplicates", "with recursive " + EV + ", " + _numbered("ev") + f""", fo as (
  select media_id, n, ord, s, e, text, ord as first_ord from nb where n = 1 union all
  select nb.media_id, nb.n, nb.ord, case when same then least(fo.s, nb.s) else nb.s end, case when same then greatest(fo.e, nb.e) else nb.e end, nb.text, case when same then fo.first_ord else nb.ord end
  from (select fo.*, nb.ord as o2, fo.text = nb.text and ((nb.s - fo.e between -0.05e0 and 0.2e0) or (least(fo.e, nb.e) - greatest(fo.s, nb.s) > 0 and least(fo.e - fo.s, nb.e - nb.s) > 0 and (least(fo.e, nb.e) - greatest(fo.s, nb.s)) / least(fo.e - fo.s, nb.e - nb.s) >= 0.5)) as same from fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1) fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1)
select media_id, first_ord as ord, {_MS('min(s)')} as s_ms, {_MS('max(e)')} as e_ms, min(text) as text from fo group by 1, 2""")
def iv03(spark, d):
    found = folds.merge_duplicates(ad.event_segments(spark, d))
    return found.select("media_id", "ord", millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"), "text")


@query("iv05_sentences", "with recursive " + EV + ", " + _numbered("ev") + """, fo as (
  select media_id, n, s as gs, e as ge, length(text) as chars, 0 as idx from nb where n = 1 union all
  select nb.media_id, nb.n, case when cut then nb.s else gs end, nb.e, case when cut then length(nb.text) else chars + 1 + length(nb.text) end, case when cut then idx + 1 else idx end
  from (select fo.*, chars >= 32 or nb.s - ge >= 0.8e0 or nb.e - gs >= 7e0 as cut from fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1) fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1)
select media_id, cast(idx as bigint) as idx, count(*) as words, cast(floor(min(gs) * 1000 + 0.5) as bigint) as s_ms from fo group by 1, 2""")
def iv05(spark, d):
    return folds.sentences(ad.event_segments(spark, d)).select("media_id", "idx", "words", millis(F.col("s")).alias("s_ms"))


@query("iv07_clip_windows", "with recursive " + EV + ", vv as (select * from ev where e > s), " + _numbered("vv") + f""", fo as (
  select media_id, n, s as gs, e as ge, 0 as idx from nb where n = 1 union all
  select nb.media_id, nb.n, case when cut then nb.s else gs end, case when cut then nb.e else greatest(ge, nb.e) end, case when cut then idx + 1 else idx end
  from (select fo.*, nb.e - gs > 30 as cut from fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1) fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1)
select media_id, cast(idx as bigint) as idx, {_MS('min(gs)')} as s_ms, {_MS('max(ge)')} as e_ms, count(*) as members from fo group by 1, 2""")
def iv07(spark, d):
    found = folds.clip_windows(ad.event_segments(spark, d))
    return found.select("media_id", "idx", millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"), "members")


@query("iv10_pack_speech", "with recursive " + EV + ", " + SP + """, pt as (select media_id, s, e, idx, unnest(range(greatest(1, cast(ceil((e - s - 0.001e0) / 30e0) as bigint)))) as k from sp where e > s and s >= 0),
pc as (select media_id, s + k * 30e0 as a, case when e - (s + k * 30e0) <= 30.001e0 then e else s + k * 30e0 + 30 end as b, s, e, idx, k from pt where s + k * 30e0 < e - 0.001e0),
nb as (select *, floor((b - a) * 1000 + 0.5) / 1000 as len, row_number() over (partition by media_id order by s, e, idx, k) as n from pc where floor((b - a) * 1000 + 0.5) > 0),
fo as (select media_id, n, a, b, len, 0 as bin, 0e0 as u0, len as used from nb where n = 1 union all
  select nb.media_id, nb.n, nb.a, nb.b, nb.len, case when cut then bin + 1 else bin end, case when cut then 0e0 else used end, case when cut then nb.len else floor((used + nb.len) * 1000 + 0.5) / 1000 end
  from (select fo.*, used > 0 and used + nb.len > 30.001e0 as cut from fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1) fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1)
select media_id, bin::bigint as bin, """ + f"{_MS('a')} as src_s_ms, {_MS('b')} as src_e_ms, {_MS('u0')} as out_s_ms, {_MS('u0 + len')} as out_e_ms from fo")
def iv10(spark, d):
    """Speech in bins of thirty seconds, and the time map of each bin."""
    found = folds.pack_speech(ad.speech(spark, d).withColumn("ord", F.col("idx")))
    return found.select("media_id", "bin", *[millis(F.col(c)).alias(f"{c}_ms") for c in ("src_s", "src_e", "out_s", "out_e")])


@query("iv13_group_segments", """with recursive ls as (select l_orderkey as media_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n, l_quantity as d, l_returnflag = 'A' as fresh from lineitem),
fo as (select media_id, n, d as used, 1 as c, 0 as grp from ls where n = 1 union all
  select ls.media_id, ls.n, case when cut then ls.d else used + ls.d end, case when cut then 1 else c + 1 end, case when cut then grp + 1 else grp end
  from (select fo.*, ls.fresh or used + ls.d > 60 or c >= 3 as cut from fo join ls on ls.media_id = fo.media_id and ls.n = fo.n + 1) fo join ls on ls.media_id = fo.media_id and ls.n = fo.n + 1)
select media_id, n as ord, cast(grp as bigint) as grp from fo""")
def iv13(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    end = F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.row_number().over(order).cast("long").alias("ord"), (end - F.col("l_quantity")).alias("s"), end.alias("e"), (F.col("l_returnflag") == "A").alias("starts_new"))
    return folds.group_segments(rows, 60.0, 3)


def logical_parts_sql(context: str = "false") -> str:
    """Views nb (a media's parts, numbered) and fo (the chunk told for each part; null: none). context: whether a part is a
    chunk of its own."""
    return "with recursive " + EV + f""", nb as (select *, {context} as ctx from (select media_id, ord, s, e, text = 'click' as quiet, case when text <> 'error' then s end as vs, case when text <> 'error' then e end as ve, row_number() over (partition by media_id order by s, ord) as n from ev where e > s)),
fo as (select media_id, 0::bigint as n, 0::bigint as ord, 0 as num, null::double as st, 0e0 as en, null::double as sp, null::int as told from (select distinct media_id from nb) union all
  select media_id, n, ord, case when quiet then num + (st is not null)::int else num1 + full_::int end, case when quiet or full_ then null else st1 end, case when quiet then en else e end,
    case when quiet then case when st is not null then null else sp end when full_ then null else coalesce(ve, sp1) end, case when quiet then null else num1 end
  from (select *, ctx or e - st1 >= 30 as full_ from (select *, num + brk::int as num1, case when brk or st is null then s else st end as st1, case when brk then null else sp end as sp1 from (
    select nb.*, fo.num, fo.st, fo.en, fo.sp, fo.st is not null and (nb.ctx or (fo.sp is not null and nb.vs is not null and nb.vs - fo.sp >= 2) or fo.en - fo.st + (nb.e - nb.s) > 30) as brk from fo join nb on nb.media_id = fo.media_id and nb.n = fo.n + 1))))"""


@query("st03_logical_chunks", logical_parts_sql() + " select media_id, ord, told::bigint as chunk from fo where told is not null")
def st03(spark, d):
    """Parts of audio to logical chunks, in a batch."""
    ev = ad.event_segments(spark, d).where("e > s")
    known = F.col("text") != "error"
    rows = ev.select("media_id", "ord", "s", "e", (F.col("text") == "click").alias("silent"), F.when(known, F.col("s")).alias("speech_s"), F.when(known, F.col("e")).alias("speech_e"))
    return folds.logical_chunks(rows, 30.0)


@query("f07_hallucinations", ad.with_views(EV) + f"select media_id, ord, length({key_sql('text')}) >= 6 and case when no_speech > 0.6e0 and lp is not null then lp <= -1 else compression >= 8 end as bad from (select *, case when ord % 2 = 0 then -no_speech * 1.5e0 end as lp from ev)")
def f07(spark, d):
    rows = ad.event_segments(spark, d).withColumn("lp", F.when(F.col("ord") % 2 == 0, -F.col("no_speech") * 1.5))
    return rows.select("media_id", "ord", guards.is_hallucinated(F.col("text"), F.col("no_speech"), F.col("lp"), F.col("compression")).alias("bad"))


@query("f03_chunk_ownership", ad.with_views(EV) + """, c as (select *, 100e0 as cs, 700e0 as ce, e - s as d from ev), o as (select *, greatest(0e0, least(e, ce) - greatest(s, cs)) as i, greatest(0e0, least(e, ce + 1.5e0) - greatest(s, cs - 1.5e0)) as p from c)
select media_id, ord from o where e > s and not (d > 900 and i / d < 0.5) and (i > 0 or (p > 0 and d <= 8 and p >= least(0.35e0, greatest(0.08e0, d * 0.12e0))))""")
def f03(spark, d):
    owned = guards.owned_by_core(F.col("s"), F.col("e"), F.lit(100.0), F.lit(700.0))
    return ad.event_segments(spark, d).where(owned).select("media_id", "ord")


_HEARD = """hd as (select * from {src} x where not exists (select 1 from sp where sp.media_id = x.media_id) or exists (select 1 from sp where sp.media_id = x.media_id and x.s < sp.e + 0.45e0 and sp.s - 0.45e0 < x.e
  and (x.s + (x.e - x.s) / 2 between sp.s - 0.45e0 and sp.e + 0.45e0 or least(x.e, sp.e + 0.45e0) - greatest(x.s, sp.s - 0.45e0) >= least(0.25e0, greatest(0.05e0, (x.e - x.s) * 0.15e0)))))"""


@query("f05_speech_activity", ad.with_views(EV, SP, SG, _HEARD.format(src="sg")) + "select media_id, ord from hd")
def f05(spark, d):
    return speech_quality.speech_active(ad.views(spark, d), ad.speech(spark, d)).select("media_id", "ord")


def _worded(spark, d):
    """Turns with a word per blank, evenly spread, every third long and every fifth unlikely."""
    t = ad.turns(spark, d)
    parts = F.split("text", " ")
    n = F.size(parts)
    step = (F.col("e") - F.col("s")) / n
    words = F.transform(parts, lambda x, i: F.struct((F.col("s") + i * step).alias("start"), (F.col("s") + (i + F.when(i % 3 == 0, 2.5).otherwise(0.9)) * step).alias("end"), x.alias("text"), F.when(i % 5 == 0, 0.1).otherwise(0.9).alias("probability")))
    return t.select("media_id", "ord", "s", "e", "text", words.alias("words"), (F.col("ord") % 10 / 10.0).alias("no_speech"), F.lit(2.0).alias("compression"), F.lit(-0.3).alias("logprob"))


#: Content words of turns as _worded makes them, and what word_stats tells of them.
_WORDS = f"""wd as (select media_id, ord, s, e, text, t[i + 1] as w, i, s + i * step as ws, s + (i + case when i % 3 = 0 then 2.5e0 else 0.9e0 end) * step as we, case when i % 5 = 0 then 0.1e0 else 0.9e0 end as p
  from (select *, (e - s) / len(t) as step, unnest(range(len(t))) as i from (select *, string_split(text, ' ') as t from tn))),
cw as (select *, row_number() over (partition by media_id, ord order by i) as nth from wd where not regexp_matches(w, '^[{tx.WS}{tx.PUNCT.replace(chr(39), chr(39) * 2)}]+$') and we > ws),
ag as (select media_id, ord, count(*) as n_words, count(*) filter (p < 0.15) as weak, count(*) filter (p < 0.2) as low, max(we - ws) as longest, string_agg(w, '' order by i) as said, count(*) filter (nth <= 8) as n8,
  coalesce(sum(case when p < 0.15 then 1e0 else 0e0 end + case when we - ws < 0.133e0 then (0.133e0 - (we - ws)) * 15 else 0e0 end + case when we - ws > 2 then we - ws - 2 else 0e0 end) filter (nth <= 8), 0) as score,
  count(*) filter (nth <= 8 and (p < 0.2 or we - ws < 0.133e0 or we - ws > 2)) as odd8 from cw group by 1, 2),
st as (select tn.media_id, tn.ord, e - s as d, tn.text, coalesce(n_words, 0) as n_words, coalesce(weak, 0) as weak, coalesce(low, 0) as low, coalesce(longest, 0) as longest, coalesce(n8, 0) as n8, coalesce(score, 0) as score, coalesce(odd8, 0) as odd8, tn.ord % 10 / 10e0 as no_speech,
  length(regexp_replace({clean_sql('tn.text')}, '[{tx.WS}{tx.PUNCT.replace(chr(39), chr(39) * 2)}]+', '', 'g')) as chars, length(regexp_replace({clean_sql("coalesce(said, '')")}, '[{tx.WS}{tx.PUNCT.replace(chr(39), chr(39) * 2)}]+', '', 'g')) as word_chars from tn left join ag on ag.media_id = tn.media_id and ag.ord = tn.ord),
gd as (select *, case when chars > 0 then word_chars / chars else 1e0 end as cover, n8 >= 2 and odd8 >= 2 as suspicious, n8 > 0 and (score >= 3 or score + 0.01 >= n8) as anomaly from st),
g2 as (select *, chars >= 10 and word_chars > 0 and cover < 0.35 as coverage, d >= 6 and n_words between 1 and 12 and ((longest >= least(6, greatest(3.5, d * 0.45)) and (d >= 10 or low > 0)) or (no_speech >= 0.6 and (suspicious or (d >= 8 and n_words <= 8 and longest >= 3)))) as severe from gd)"""


@query("a05_word_stats", ad.with_views(ad.TURNS) + """, w as (select media_id, ord, e - s as d, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as i, len(string_split(text, ' ')) as n from tn)
select media_id, ord::bigint as ord, count(*) filter (regexp_matches(word, '[^.,!?;:''"()\\[\\]{}-]')) as n_words, count(*) filter (i % 5 = 0 and regexp_matches(word, '[^.,!?;:''"()\\[\\]{}-]')) as weak from w group by 1, 2""")
def a05(spark, d):
    return guards.word_stats(_worded(spark, d)).select("media_id", F.col("ord").cast("long").alias("ord"), "n_words", "weak")


@query("f08_word_guards", ad.with_views(ad.TURNS, _WORDS) + "select media_id, ord, severe, suspicious, anomaly, n_words > 0 and chars >= 6 and (coverage or (weak >= 1 and chars >= 10 and cover < 0.7) or weak >= 2 or (weak >= 1 and (d >= 3 or longest >= 2.5 or n_words <= 2))) as weak_evidence, coverage, false as vad from g2")
def f08(spark, d):
    """The word tests side by side."""
    stats = guards.word_stats(_worded(spark, d))
    return stats.select("media_id", "ord", guards.is_severe_timing().alias("severe"), guards.is_suspicious_timing().alias("suspicious"), guards.is_word_anomaly().alias("anomaly"), guards.weak_evidence().alias("weak_evidence"), guards.coverage_suspicious().alias("coverage"), guards.is_vad_hallucination().alias("vad"))


@query("f13_strict_recovery", ad.with_views(ad.TURNS, _WORDS, kind_sql("text", "tn", "kt")) + """, cp as (select *, chars >= 5 and n_words >= 5 and cover >= 0.8 and weak <= 1 and longest <= 0.75 and no_speech <= 0.8 as compact, chars >= 10 and n_words >= 6 and weak = 0 and longest <= 1 and no_speech <= 0.58 as substantial from g2)
select media_id, ord from cp join kt using (media_id, ord) where d > 0 and d <= 8 and cp.text <> '' and kind is null and (substantial or compact or not (anomaly or suspicious))
  and not ((chars <= 2 and no_speech >= 0.35) or (no_speech >= 0.5 and not compact and (chars < 10 or (chars < 14 and weak > 0 and longest >= 1))))""")
def f13(spark, d):
    return guards.strict_recovery(_worded(spark, d)).select("media_id", "ord")


@query("iv04_split_at_word_gaps", ad.with_views(ad.TURNS, _WORDS) + f""", lt as (select *, ws + i // 20 * 12 as a, we + i // 20 * 12 as b from wd where we > ws and not regexp_matches(w, '^[{tx.WS}{tx.PUNCT.replace(chr(39), chr(39) * 2)}]+$')),
il as (select *, sum(case when a - before > 10 then 1 else 0 end) over (partition by media_id, ord order by i) as part from (select *, lag(b) over (partition by media_id, ord order by i) as before from lt where e - s >= 8)),
pt as (select media_id, ord, part, min(a) as s, string_agg(w, ' ' order by i) as text, count(*) over (partition by media_id, ord) as parts from il group by 1, 2, 3)
select media_id, ord, part::bigint as part, {_MS('s')} as s_ms, text from pt where parts > 1 union all select media_id, ord, 0, {_MS('s')}, text from tn where not exists (select 1 from pt where parts > 1 and pt.media_id = tn.media_id and pt.ord = tn.ord)""")
def iv04(spark, d):
    """Turns of which every word starts twelve seconds later than the text before it lasts."""
    late = F.transform("words", lambda w, i: w.withField("start", w["start"] + F.floor(i / 20) * 12).withField("end", w["end"] + F.floor(i / 20) * 12))
    found = guards.split_at_word_gaps(_worded(spark, d).withColumn("words", late))
    return found.select("media_id", "ord", F.col("part").cast("long").alias("part"), millis(F.col("s")).alias("s_ms"), "text")


_CHAIN = f"""q as (select *, {key_sql('text')} as k from ev where e > s and not (length({key_sql('text')}) >= 6 and compression >= 8)),
fl as (select *, sum(new) over (partition by media_id order by s, e, ord) as island from (select *, case when lag(k) over (partition by media_id order by s, e, ord) is distinct from k or k = '' then 1 else 0 end as new from q)),
rn as (select *, count(*) over w as n, sum(e - s) over w as total from fl window w as (partition by media_id, island)),
kept as (select * from rn where not (length(k) >= 6 and n >= 4 and total >= 6))"""
_ISLANDS = """ui as (select *, sum(case when reach is null or s > reach + 0.15e0 then 1 else 0 end) over (partition by media_id order by s, e, idx) as island from (select *, max(e) over (partition by media_id order by s, e, idx rows between unbounded preceding and 1 preceding) as reach from sp)),
uu as (select media_id, count(*) as intervals, sum(e - s) as speech from (select media_id, island, min(s) as s, max(e) as e from ui group by 1, 2) group by 1)"""


@query("flagship_speech_quality", ad.with_views(EV, SP, _CHAIN, _HEARD.format(src="kept"), _ISLANDS) + f""", t as (select media_id, count(*) as segments from ev group by 1), h as (select media_id, count(*) as kept from hd group by 1)
select media_id, segments, coalesce(h.kept, 0) as kept, coalesce(intervals, 0) as intervals, {_MS('coalesce(speech, 0)')} as speech_ms from t left join h using (media_id) left join uu using (media_id)""")
def flagship(spark, d):
    """Segments through the quality chain, against the union of speech."""
    found = speech_quality.report(ad.event_segments(spark, d), ad.speech(spark, d))
    return found.select("media_id", "segments", "kept", "intervals", millis(F.col("speech")).alias("speech_ms"))
