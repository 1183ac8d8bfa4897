"""Queries of reconciliation, alignment, lookups and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuetide.functions.text import clean_import, clean_plain
from cuetide.functions.times import millis
from cuetide.operators import candidates, export, reconcile
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query

BI = ad.with_views(ad.TURNS, ad.BILINGUAL)
_MERGED = """, mg as (select coalesce(src.media_id, tra.media_id) as media_id, src.s as src_s, src.e as src_e, src.text as src_text, tra.s as tra_s, tra.e as tra_e, tra.text as tra_text
  from src full join tra using (media_id, chunk, seg))"""


def plain_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g'), '[\\s\\x0b\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'), '^ | $', '', 'g')".replace("{{", "{").replace("}}", "}")


_CUES = f""", cz as (select media_id, coalesce(tra_s, src_s) as s, coalesce(tra_e, src_e) as e, {plain_sql('tra_text')} as t, {plain_sql('src_text')} as o from mg),
cq as (select media_id, s, e, case when t <> '' then t else o end as text, case when o <> '' and (t = '' or o <> t) then o else '' end as source_text, t = '' and o <> '' as source_only from cz where (t <> '' or o <> '') and s is not null and e is not null)"""
_MS = lambda c: f"cast(floor(({c}) * 1000 + 0.5) as bigint)"


def _merged(spark, d, mode="panel"):
    return reconcile.reconcile(*ad.bilingual(spark, d), mode=mode)


def _times(df):
    return df.select("media_id", *[millis(F.col(c)).alias(f"{c}_ms") for c in ("src_s", "tra_s")], "src_text", "tra_text")


_TIMES = f"select media_id, {_MS('src_s')} as src_s_ms, {_MS('tra_s')} as tra_s_ms, src_text, tra_text from mg"


@query("j06_reconcile_panel", BI + _MERGED + _TIMES)
def j06(spark, d):
    return _times(_merged(spark, d))


@query("j06_reconcile_bilingual", BI + _MERGED + _TIMES)
def j06b(spark, d):
    return _times(_merged(spark, d, "bilingual"))


@query("j07_reconcile_live", BI + _MERGED + f"select media_id, {_MS('coalesce(tra_s, src_s)')} as s_ms, coalesce(tra_text, src_text) as text from mg")
def j07(spark, d):
    return reconcile.display_rows(_merged(spark, d, "live")).select("media_id", millis(F.col("s")).alias("s_ms"), "text")


@query("j08_zip_by_place", BI + ", a as (select *, row_number() over (partition by media_id order by ord) as p from src), b as (select *, row_number() over (partition by media_id order by ord) as p from tra) select coalesce(a.media_id, b.media_id) as media_id, a.text as src_text, b.text as tra_text from a full join b on a.media_id = b.media_id and a.p = b.p")
def j08(spark, d):
    """Lists without identities."""
    lists = [x.withColumns({"chunk": F.lit(None).cast("long"), "seg": F.lit(None).cast("long")}) for x in ad.bilingual(spark, d)]
    return reconcile.reconcile(*lists).select("media_id", "src_text", "tra_text")


@query("p18_cues", BI + _MERGED + _CUES + f" select media_id, {_MS('s')} as s_ms, {_MS('e')} as e_ms, text, source_text, source_only from cq")
def p18(spark, d):
    return reconcile.cues(_merged(spark, d)).select("media_id", millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"), "text", "source_text", "source_only")


@query("f15_shown_cues", BI + _MERGED + _CUES + " select media_id, text from (select *, bool_or(not source_only) over (partition by media_id) as real from cq) where not source_only or not real")
def f15(spark, d):
    return reconcile.shown_cues(reconcile.cues(_merged(spark, d))).select("media_id", "text")


@query("p07_usable_segments", ad.with_views(ad.EVENT_SEGMENTS) + "select media_id, count(*) as kept, count(*) filter (e = s) as empty_spans from ev where e >= s and text <> '' group by 1")
def p07(spark, d):
    """Imported rows need an end not before their start, and text; spans without length stay."""
    rows = ad.event_segments(spark, d).where((F.col("e") >= F.col("s")) & (clean_import(F.col("text")) != ""))
    return rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("e") == F.col("s")).alias("empty_spans"))


@query("p09_chunk_segments", "select l_orderkey as job_id, l_linenumber::bigint as chunk, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as place, l_partkey as seg from lineitem")
def p09(spark, d):
    """Segments of all chunks of a job in one order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("chunk"), place.cast("long").alias("place"), F.col("l_partkey").alias("seg"))


@query("p10_chunk_defaults", "select l_orderkey as job_id, l_linenumber::bigint as idx, coalesce(case when l_tax > 0.04 then l_quantity end, l_discount * 10) as core_start, coalesce(case when l_tax > 0.06 then l_quantity + 5 end, case when l_tax > 0.02 then l_quantity + 10 end, l_discount * 10 + l_quantity) as core_end from lineitem")
def p10(spark, d):
    """The core window of a chunk, from its own start and end, or its duration, where it has none."""
    q, tax, start = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount") * 10
    core_end = F.coalesce(F.when(tax > 0.06, q + 5), F.when(tax > 0.02, q + 10), start + q)
    return ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("idx"), F.coalesce(F.when(tax > 0.04, q), start).alias("core_start"), core_end.alias("core_end"))


_ITEMS = """it as (select l_orderkey as batch_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as pos, case when l_quantity > 25 then l_suppkey % 5 end as i, case when l_tax > 0.01 then l_returnflag || l_linenumber else ' ' end as text from lineitem),
sz as (select batch_id, 4 as n from it group by 1)"""


@query("j09_align_translations", "with " + _ITEMS + f""", pl as (select it.batch_id, it.pos, n, coalesce(i, pos) as idx, {plain_sql('text')} as t from it join sz using (batch_id)),
ft as (select *, idx >= 0 and idx < n and t <> '' as fits from pl), nt as (select *, row_number() over (partition by batch_id, idx, fits order by pos) as nth from ft),
bad as (select batch_id, count(*) as invalid from nt where not (fits and nth = 1) group by 1),
w as (select batch_id, unnest(range(n)) as idx from sz)
select w.batch_id, w.idx, g.t as text, coalesce(invalid, 0) as invalid from w left join (select * from nt where fits and nth = 1) g on g.batch_id = w.batch_id and g.idx = w.idx left join bad on bad.batch_id = w.batch_id""")
def j09(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    items = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), place.cast("long").alias("pos"), F.when(F.col("l_quantity") > 25, F.col("l_suppkey") % 5).alias("i"), F.when(F.col("l_tax") > 0.01, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).otherwise(" ").alias("text"))
    sizes = items.select("batch_id").distinct().withColumn("n", F.lit(4).cast("long"))
    return reconcile.align(items, sizes)


@query("j13_lookup_without_query", "with u as (select page_id, url, regexp_replace(url, '[?#].*$', '') as bare from pages), m as (select bare, min(page_id) as hit from u where url = bare group by 1) select u.page_id, coalesce(e.hit, m.hit) as manifest from u left join m e on e.bare = u.url left join m on m.bare = u.bare")
def j13(spark, d):
    """A table of manifests by URL, looked up by the URL, then by the URL without its query."""
    pages = ad.table(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("bare"))
    known = pages.where("url = bare").groupBy("bare").agg(F.min("page_id").alias("hit"))
    exact = known.select(F.col("bare").alias("_exact"), F.col("hit").alias("_hit"))
    return pages.join(exact, F.col("url") == F.col("_exact"), "left").join(known, "bare", "left").select("page_id", F.coalesce("_hit", "hit").alias("manifest"))


@query("j14_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def j14(spark, d):
    """Direct candidates that no reconstructable group has."""
    done = ad.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return ad.table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j15_candidates_with_page", "select e.event_id, u.last_ts - e.event_id as behind from events e join (select user_id, max(event_id) as last_ts from events where event_type = 'view' group by 1) u using (user_id)")
def j15(spark, d):
    """Events with their tab's page state."""
    events = ad.table(spark, d, "events")
    state = events.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("_last"))
    return events.join(state, "user_id").select("event_id", (F.col("_last") - F.col("event_id")).alias("behind"))


@query("j17_cue_or_previous", ad.with_views(ad.DOC_CUES) + ", pt as (select doc_id as media_id, i as point_id, i * 2.75e0 as t from documents, range(6) r(i)) select pt.media_id, point_id, coalesce(max(ord) filter (s <= t), 0) as cue from pt join cu using (media_id) group by 1, 2")
def j17(spark, d):
    """The cue at a time, or the one before it, or the first: the last cue that has started."""
    points = ad.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("point_id")).withColumn("t", F.col("point_id") * F.lit(2.75))
    cues = ad.doc_cues(spark, d).select("media_id", "ord", "s")
    both = points.select("media_id", "point_id", F.col("t").alias("at"), F.lit(1).alias("own"), F.lit(None).cast("long").alias("ord")).unionByName(cues.select("media_id", F.lit(None).cast("long").alias("point_id"), F.col("s").alias("at"), F.lit(0).alias("own"), "ord"))
    last = F.last("ord", ignorenulls=True).over(Window.partitionBy("media_id").orderBy("at", "own", "ord").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("cue", F.coalesce(last, F.lit(0).cast("long"))).where("own = 1").select("media_id", "point_id", "cue")


@query("j18_cascading_lookup", """with k as (select doc_id as id, source as page, lang as src, n_chars as seen from documents), q as (select distinct source as page, lang as src from documents),
h as (select q.page, q.src, k.id, case when k.page = q.page and k.src = q.src then 1 else 2 end as rnk, k.seen from q join k on k.page = q.page)
select page, src, id, rnk from (select *, row_number() over (partition by page, src order by rnk, seen desc, id) as nth from h) where nth = 1""")
def j18(spark, d):
    """The newest entry of page and media, else of the page."""
    docs = ad.table(spark, d, "documents")
    wanted = docs.select(F.col("source").alias("page"), F.col("lang").alias("src")).distinct()
    entries = docs.select(F.col("source").alias("_page"), F.col("lang").alias("_src"), F.col("doc_id").alias("id"), F.col("n_chars").alias("at"))
    exact = entries.groupBy(F.col("_page"), F.col("_src")).agg(F.min_by("id", F.struct(-F.col("at"), F.col("id"))).alias("_exact"))
    by_page = entries.groupBy(F.col("_page").alias("_p")).agg(F.min_by("id", F.struct(-F.col("at"), F.col("id"))).alias("_any"))
    found = wanted.join(exact, (F.col("page") == F.col("_page")) & (F.col("src") == F.col("_src")), "left").join(by_page, F.col("page") == F.col("_p"), "left")
    return found.select("page", "src", F.coalesce("_exact", "_any").alias("id"), F.when(F.col("_exact").isNotNull(), 1).otherwise(2).alias("rnk"))


@query("j22_same_target", "select page_id, min(page_id) over (partition by u) as target_id, count(*) over (partition by u) as members from (select page_id, regexp_replace(url, '[?#].*$', '') as u from pages)")
def j22(spark, d):
    """Pages with the first page that means their target: equal URLs without query and fragment. Targets are aggregated
    before the join, so one with very many pages costs a row."""
    bare = ad.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"))
    targets = bare.groupBy(F.col("u").alias("_u")).agg(F.min("page_id").alias("target_id"), F.count(F.lit(1)).alias("members"))
    return bare.join(targets, F.col("u") == F.col("_u")).select("page_id", "target_id", "members")


#: Candidates of a key k: a site's medium on one of its hosts, or a stream in a variant. Their URL, canonical URL and
#: fingerprint by construction.
_CANDIDATE = """select tab, id, k, case when k % 4 = 0 then 'https://cdn' || k % 3 || '.bilivideo.com/upgcxcode/a/' || k % 40 || '-1-30280.m4s?e=' || k % 5 else 'https://h.example/' || case k % 3 when 0 then '720p' when 1 then '128k' else 'x' end || '/seg-' || k % 40 || case when k % 2 = 0 then '.m3u8' else '.mp4' end || '?t=' || k % 5 end as url,
case when k % 4 = 0 then 'cdn' || k % 3 || '.bilivideo.com/upgcxcode/a/' || k % 40 || '-1-{track}.m4s' else 'h.example/' || case when k % 3 < 2 then '{quality}' else 'x' end || '/seg-' || k % 40 || case when k % 2 = 0 then '.m3u8' else '.mp4' end end as canonical,
case when k % 4 = 0 then 'site ' || k % 40 else url end as fingerprint"""


def _target_candidates(df, tab: str, key: str):
    k = F.col("k")
    text = lambda c: c.cast("string")
    site = F.concat(F.lit("https://cdn"), text(k % 3), F.lit(".bilivideo.com/upgcxcode/a/"), text(k % 40), F.lit("-1-30280.m4s?e="), text(k % 5))
    other = F.concat(F.lit("https://h.example/"), F.when(k % 3 == 0, "720p").when(k % 3 == 1, "128k").otherwise("x"), F.lit("/seg-"), text(k % 40), F.when(k % 2 == 0, ".m3u8").otherwise(".mp4"), F.lit("?t="), text(k % 5))
    rows = df.select(F.col(tab).alias("tab"), F.col(key).alias("id"), F.col(key).alias("k"))
    kind = F.when(k % 4 == 0, "audio").when(k % 2 == 0, "hls").otherwise("media")
    return rows.select("tab", "id", F.when(k % 4 == 0, site).otherwise(other).alias("url"), kind.alias("kind"), F.lit("").alias("ext"), F.lit("").alias("role"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("boolean").alias("picture"), (-k).alias("ord"))


@query("j22_or_match", f"""with known as ({_CANDIDATE} from (select c_nationkey as tab, c_custkey as id, c_custkey as k from customer)), wanted as ({_CANDIDATE} from (select s_nationkey as tab, s_suppkey as id, s_suppkey as k from supplier)),
p as (select w.tab, w.id, known.id as target, case when w.url = known.url then 'url' when w.canonical = known.canonical then 'canonical' else 'fingerprint' end as by from wanted w join known on w.tab = known.tab and (w.url = known.url or w.canonical = known.canonical or w.fingerprint = known.fingerprint))
select * from p qualify row_number() over (partition by tab, id order by target desc) = 1""")
def j22_or(spark, d):
    """Candidates to start with, and the newest one known of the tab that means the same."""
    return candidates.same_target(_target_candidates(ad.table(spark, d, "supplier"), "s_nationkey", "s_suppkey"), _target_candidates(ad.table(spark, d, "customer"), "c_nationkey", "c_custkey"))


@query("p15_restore_words", """with pc as (select user_id as map_id, row_number() over (partition by user_id order by event_id) - 1 as n, epoch_us(ts) / 1e9 as src from events where event_type = 'purchase'),
pieces as (select map_id, n * 10e0 as out_s, n * 10e0 + 8 as out_e, src as src_s, src + 16 as src_e from pc),
w as (select user_id as map_id, event_id, value as s, value + 1 as e from events where event_type = 'click'),
j as (select w.*, out_s, out_e, src_s, src_e, row_number() over (partition by w.map_id, event_id order by (out_e > s + (e - s) / 2) desc, case when out_e > s + (e - s) / 2 then out_s else -out_s end) as nth from w join pieces using (map_id))
select map_id, event_id, cast(floor((src_s + (s - out_s) * ((src_e - src_s) / (out_e - out_s))) * 1000 + 0.5) as bigint) as s_ms from j where nth = 1""")
def p15(spark, d):
    """A word's middle picks the piece that both of its ends are restored with."""
    from cuetide.operators.intervals import as_of_piece

    events = ad.table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    src = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e9)
    pieces = events.where("event_type = 'purchase'").select(F.col("user_id").alias("map_id"), (n * F.lit(10.0)).alias("out_s"), src.alias("src_s")).withColumns({"out_e": F.col("out_s") + 8, "src_e": F.col("src_s") + 16})
    words = events.where("event_type = 'click'").select(F.col("user_id").alias("map_id"), "event_id", F.col("value").alias("s"), (F.col("value") + 1).alias("e")).join(pieces.select("map_id").distinct(), "map_id")
    middle = words.select("map_id", F.col("event_id").alias("point_id"), (F.col("s") + (F.col("e") - F.col("s")) / 2).alias("t"))
    restored = as_of_piece(middle, pieces)  # every piece runs at a rate of two
    return restored.select("map_id", F.col("point_id").alias("event_id"), millis(F.col("source_t") - 1.0).alias("s_ms"))


_TS = lambda c, m: f"lpad(cast(cast(floor({c} / 3600) as bigint) as varchar), 2, '0') || ':' || lpad(cast(cast(floor(({c} % 3600) / 60) as bigint) as varchar), 2, '0') || ':' || lpad(cast(cast(floor({c} % 60) as bigint) as varchar), 2, '0') || '{m}' || lpad(cast(cast(floor(({c} - floor({c})) * 1000) as bigint) as varchar), 3, '0')"
_LINES = ad.with_views(ad.DOC_CUES) + f", k as (select *, {plain_sql('text')} as t from cu), n as (select *, row_number() over (partition by media_id order by s, ord) as n from k where t <> '')"


@query("sk02_srt_files", _LINES + f" select media_id, string_agg(n || chr(10) || {_TS('s', ',')} || ' --> ' || {_TS('e', ',')} || chr(10) || t, chr(10) || chr(10) order by n) || chr(10) as srt from n group by 1")
def sk02(spark, d):
    return export.to_srt(ad.doc_cues(spark, d).withColumn("text", clean_plain(F.col("text"))))


@query("sk01_vtt_files", _LINES + f" select media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_TS('s', '.')} || ' --> ' || {_TS('e', '.')} || chr(10) || t || chr(10), chr(10) order by n) as vtt from n group by 1")
def sk01(spark, d):
    return export.to_vtt(ad.doc_cues(spark, d).withColumn("text", clean_plain(F.col("text"))))


@query("sk03_bilingual_vtt", BI + _MERGED + _CUES + f""" select media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_TS('s', '.')} || ' --> ' || {_TS('e', '.')} || chr(10) || case when source_text <> '' and source_text <> text then source_text || chr(10) || text else text end || chr(10), chr(10) order by s, e) as vtt from cq group by 1""")
def sk03(spark, d):
    return export.to_vtt(reconcile.cues(_merged(spark, d)).withColumn("ord", F.col("e")), reconcile.cue_lines("bilingual"))


@query("sk05_delete_entries", "select doc_id as id from documents where doc_id not in (select item_id * 3 from benchmark)")
def sk05(spark, d):
    """The cache without a list of ids."""
    gone = ad.table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("_gone")).distinct()
    return ad.table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(gone, F.col("id") == F.col("_gone"), "left_anti")


@query("sk07_transcripts", BI + _MERGED + _CUES + f" select media_id, {_MS('s')} as s_ms, {_MS('e')} as e_ms, text, source_text, count(*) over (partition by media_id) as listed from cq")
def sk07(spark, d):
    """Cues to transcripts as JSON, read again: both lists are as long and hold the same rows."""
    found = export.transcript_json(reconcile.cues(_merged(spark, d)))
    item = "array<struct<start:double,end:double,text:string>>"
    lists = found.select("media_id", F.from_json("transcript", f"source {item}, translated {item}").alias("t"))
    rows = lists.select("media_id", F.size("t.translated").cast("long").alias("listed"), F.explode(F.arrays_zip("t.source", "t.translated")).alias("x"))
    return rows.select("media_id", millis(F.col("x.translated.start")).alias("s_ms"), millis(F.col("x.translated.end")).alias("e_ms"), F.col("x.translated.text").alias("text"), F.col("x.source.text").alias("source_text"), "listed")


@query("sc28_cache_lookup", "select doc_id as id, n_chars as bytes from documents where doc_id = 42")
def sc28(spark, d):
    return ad.table(spark, d, "documents").where("doc_id = 42").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("bytes"))


@query("f04_skip_silent_chunks", "select user_id * 1000 + dayofyear(ts) as chunk_id, case when user_id % 3 = 0 then false else count(*) filter (event_type = 'purchase') = 0 and user_id % 5 <> 0 end as skipped from events group by user_id, 1")
def f04(spark, d):
    """A user's day is a chunk, whose purchases are its speech. Chunks are skipped if their speech is known, reliable and
    none; unknown is not none."""
    spans = ad.table(spark, d, "events").groupBy("user_id", F.dayofyear("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("spans"))
    known = F.when(F.col("user_id") % 5 != 0, F.col("spans"))
    reliable = F.when(F.col("user_id") % 3 == 0, False)
    return spans.select((F.col("user_id") * 1000 + F.col("day")).alias("chunk_id"), (F.coalesce(reliable, F.lit(True)) & F.coalesce(known == 0, F.lit(False))).alias("skipped"))
