"""Queries of URLs, candidates and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuetide.functions import urls
from cuetide.operators import candidates as cd
from cuetide.operators import retention
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.sources import pages as sources_of_pages

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_PATH0 = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_PATH = f"case when {_PATH0} = '' then '/' else {_PATH0} end"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


def _pages(spark, d):
    return ad.table(spark, d, "pages")


@query("sf05_url_parts", f"select page_id, {_HOST} as host, {_PATH} as path, {_QUERY} as query, string_split({_PATH}, '/')[-1] as filename from pages")
def sf05(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query_text(u).alias("query"), urls.filename(u).alias("filename"))


#: Media URLs made of page URLs: a stream in several variants.
_MEDIA = f"""mu as (select page_id, {_HOST} || '/' || case page_id % 4 when 0 then '1280x720/a1' when 1 then '720p/v2' when 2 then 'f8-a1' else 'main-128k' end || '/seg-' || page_id || case page_id % 5 when 0 then '.m3u8' when 1 then '.mpd' when 2 then '.m4a' when 3 then '.mp4' else '.html' end || case when page_id % 7 = 0 then '?mime=audio%2Fmp4&br=96000' else '' end as u from pages)"""


def _media(spark, d):
    p = F.col("page_id")
    place = F.when(p % 4 == 0, "1280x720/a1").when(p % 4 == 1, "720p/v2").when(p % 4 == 2, "f8-a1").otherwise("main-128k")
    ext = F.when(p % 5 == 0, ".m3u8").when(p % 5 == 1, ".mpd").when(p % 5 == 2, ".m4a").when(p % 5 == 3, ".mp4").otherwise(".html")
    u = F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/"), place, F.lit("/seg-"), p.cast("string"), ext, F.when(p % 7 == 0, "?mime=audio%2Fmp4&br=96000").otherwise(""))
    return _pages(spark, d).select("page_id", "url", u.alias("u"))


_KIND = "case when page_id % 7 = 0 then 'audio' when page_id % 5 = 0 then 'hls' when page_id % 5 = 1 then 'dash' when page_id % 5 = 2 then 'audio' when page_id % 5 = 3 then 'media' end"


@query("sf04_media_kind", f"select page_id, {_KIND} as kind from pages")
def sf04(spark, d):
    return _media(spark, d).select("page_id", urls.media_kind(F.col("u")).alias("kind"))


@query("sf06_canonical_url", f"with {_MEDIA} select page_id, {_HOST} || case page_id % 4 when 0 then '/{{resolution}}-{{track}}' when 1 then '/{{quality}}-{{track}}' when 2 then '-{{track}}' else '/main-{{quality}}' end || '/seg-' || page_id || case page_id % 5 when 0 then '.m3u8' when 1 then '.mpd' when 2 then '.m4a' when 3 then '.mp4' else '.html' end as canonical from pages")
def sf06(spark, d):
    return _media(spark, d).select("page_id", urls.canonical_url(F.col("u")).alias("canonical"))


@query("sf09_url_quality", "select page_id, case when page_id % 4 = 0 then 1280 end as width, case when page_id % 4 in (0, 1) then 720 end as height, case when page_id % 7 = 0 then 96000 when page_id % 4 = 3 then 128000 end as bandwidth from pages")
def sf09(spark, d):
    q = urls.quality(F.col("u"))
    return _media(spark, d).withColumn("q", q).select("page_id", F.col("q.width").cast("int").alias("width"), F.col("q.height").cast("int").alias("height"), F.col("q.bandwidth").cast("int").alias("bandwidth"))


@query("sf10_media_role", f"select page_id, case when {_KIND} = 'audio' then 'audio' when {_KIND} in ('hls', 'dash') then case when page_id % 4 in (0, 2) then 'audio' else 'playlist' end when page_id % 5 = 2 then 'audio' else 'media' end as role from pages")
def sf10(spark, d):
    m = _media(spark, d).withColumn("kind", urls.media_kind(F.col("u")))
    return m.select("page_id", urls.media_role(F.col("kind"), F.col("u"), F.lit(""), F.lit(False)).alias("role"))


@query("sf13_cache_url", """with b as (select page_id, regexp_replace(url, '#.*$', '') as u from pages), q as (select page_id, regexp_replace(u, '\\?.*$', '') as base, list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_|spm_|vd_source=|from=|share_|fbclid=|gclid=|token=)'))) as ps from b)
select page_id, case when len(ps) > 0 then base || '?' || array_to_string(ps, '&') else base end as cache_url from q""")
def sf13(spark, d):
    return _pages(spark, d).select("page_id", urls.cache_url(F.col("url")).alias("cache_url"))


@query("sf14_query_parameters", "with p as (select unnest(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '')) as part from pages), n as (select regexp_extract(part, '^([^=]*)', 1) as name from p) select name, regexp_matches(name, '^(utm_|spm_|share_)') as tracking, count(*) as n from n group by 1, 2")
def sf14(spark, d):
    parts = _pages(spark, d).select(F.explode(F.split(urls.query_text(F.col("url")), "&")).alias("part")).where("part <> ''")
    names = parts.select(F.regexp_extract("part", "^([^=]*)", 1).alias("name"))
    return names.groupBy("name", names["name"].rlike(urls.TRACKING).alias("tracking")).agg(F.count(F.lit(1)).alias("n"))


@query("sf18_page_identity", f"select regexp_extract(lower(url), '^([a-z]+://)', 1) || {_HOST} || {_PATH} as page, count(*) as n from pages group by 1")
def sf18(spark, d):
    """Pages by origin and path."""
    return _pages(spark, d).groupBy(urls.page_identity(F.col("url")).alias("page")).agg(F.count(F.lit(1)).alias("n"))


@query("f19_same_origin", f"select page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) = 'https://' || {_HOST} as allowed from pages")
def f19(spark, d):
    return _media(spark, d).select("page_id", urls.same_origin(F.col("url"), F.col("u")).alias("allowed"))


@query("f01_placeholders", "select page_id from pages where page_id % 3 <> 0")
def f01(spark, d):
    """Without known URLs that hold no media."""
    u = F.when(F.col("page_id") % 3 == 0, "https://cdn.plyr.io/static/blank.mp4").otherwise(F.col("url"))
    return _pages(spark, d).where(~urls.is_placeholder(u)).select("page_id")


#: Markup with media URLs, escaped as pages do, before a page's own; every fifth page has that of the page before.
_MARKUP = "'<video src=\"https://cdn.example.org/v/' || (page_id // 5 * 5) || '.mp4?a=1&amp;b=2\"><a href=\"//h.example.org/list.m3u8\">' || case when page_id % 5 < 2 then '' else html end"
_URL_IN_TEXT = "(?i)((?:https?:)?//[a-z0-9\\[][^\\s\"''<>\\\\)]*)"


@query("sc06_markup_urls", f"""with m as (select page_id, url, {_MARKUP} as body from pages), u as (select page_id, url, unnest(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(body, '&amp;', '&', 'gi'), '&quot;|&#39;|&apos;|&lt;|&gt;', ' ', 'gi'), '{_URL_IN_TEXT}', 1))) as found from m)
select distinct page_id, case when starts_with(found, '//') then regexp_extract(url, '^([A-Za-z]+:)', 1) || found else found end as target from u""")
def sc06(spark, d):
    """URLs in the markup of pages."""
    body = F.expr(_MARKUP.replace("page_id // 5", "page_id div 5"))
    return sources_of_pages.markup_urls(_pages(spark, d).select("page_id", "url", body.alias("html"))).select("page_id", "target")


@query("sc05_sniffed_texts", "select page_id, case page_id % 4 when 0 then 'hls' when 1 then 'dash' else 'text' end as format, case when page_id % 4 < 2 then 1 else 2 end as found from pages")
def sc05(spark, d):
    """Texts that are manifests, and others with URLs in them."""
    k = F.col("page_id") % 4
    body = F.when(k == 0, "#EXTM3U\n#EXT-X-VERSION:3").when(k == 1, '<?xml version="1.0"?><MPD type="static">').otherwise("see https://a.example.org/x.mp3&quot; and //b.example.org/y, or https://a.example.org/x.mp3")
    found = urls.sniffed(body, F.col("url"))
    return _pages(spark, d).select("page_id", found["format"].alias("format"), F.size(found["urls"]).alias("found"))


_RATE = "case when {r} < 48000 then 8 + (48000 - {r}) / 48000 when {r} < 96000 then 1 + (96000 - {r}) / 96000 when {r} <= 160000 then 0e0 when {r} <= 320000 then 1 + ({r} - 160000) / 160000 else 5 + least(({r} - 320000) / 320000, 12e0) end".format(r="(l_extendedprice * 10)")


@query("wf11_bitrate_penalty", f"select l_orderkey, l_linenumber::bigint as line, cast(floor(({_RATE}) * 1000 + 0.5) as bigint) as penalty from lineitem")
def wf11(spark, d):
    penalty = cd.bitrate_penalty(F.col("l_extendedprice") * 10)
    return ad.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.floor(penalty * 1000 + 0.5).cast("long").alias("penalty"))


@query("wf01_retain_candidates", """with c as (select user_id as tab, event_id as seq, epoch_us(ts) as seen_at, (case when event_type = 'view' then 90 else 0 end) + (case when event_type = 'click' then 80 else 0 end) as score from events)
select tab, seq from (select *, row_number() over (partition by tab order by score desc, seen_at desc, seq) as nth from c) where nth <= 20""")
def wf01(spark, d):
    t = F.col("event_type")
    rows = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_at"), F.when(t == "view", "audio").otherwise("media").alias("role"), F.when(t == "click", "hls").otherwise("other").alias("kind"))
    score = cd.retention_score(F.col("role"), F.col("kind"), F.lit("html"), F.lit(""), F.lit("page"))
    return cd.retain(rows, score, 20).select("tab", "seq")


@query("wf06_choose_variant", "select l_orderkey as media_id, arg_min(o, struct_pack(a := not ao, r := ar, b := case when bw > 0 then bw else 9007199254740991 end, p := px, o := o)) as ord from (select l_orderkey, l_linenumber::bigint as o, l_returnflag = 'R' as ao, l_suppkey % 3 as ar, l_partkey % 50 as bw, l_quantity::bigint as px from lineitem) group by 1")
def wf06(spark, d):
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("long").alias("ord"), (F.col("l_returnflag") == "R").alias("audio_only"), (F.col("l_suppkey") % 3).alias("audio_rank"), (F.col("l_partkey") % 50).alias("bandwidth"), F.col("l_quantity").cast("long").alias("pixels"))
    return cd.choose_variant(rows, ["media_id"])


@query("wf07_near_bandwidth", "select l_orderkey as media_id, arg_min(l_linenumber::bigint, struct_pack(d := abs(case when l_partkey % 7 = 0 then 128000 else l_partkey * 100 end - 128000), o := l_linenumber)) as ord from lineitem group by 1")
def wf07(spark, d):
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").cast("long").alias("ord"), F.when(F.col("l_partkey") % 7 == 0, 0).otherwise(F.col("l_partkey") * 100).alias("bandwidth"))
    return cd.choose_near_bandwidth(rows, ["media_id"])


@query("wf08_track_preference", "select l_orderkey as media_id, arg_min(l_linenumber::bigint, struct_pack(p := case l_suppkey % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end, d := abs(l_partkey * 100 - 132000), o := l_linenumber)) as ord from lineitem group by 1")
def wf08(spark, d):
    """By a site's track number, then the distance from 132 kbit/s."""
    order = F.struct(F.col("l_suppkey") % 4, F.abs(F.col("l_partkey") * 100 - 132_000), F.col("l_linenumber"))
    return ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(F.min_by(F.col("l_linenumber").cast("long"), order).alias("ord"))


@query("wf09_shown_candidates", "select tab, seq, hidden from (select user_id as tab, event_id as seq, row_number() over (partition by user_id order by value desc, event_id) as nth, greatest(count(*) over (partition by user_id) - 5, 0) as hidden from events) where nth <= 5")
def wf09(spark, d):
    """The five best of a tab, and how many are not shown."""
    own = Window.partitionBy("user_id")
    rows = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), F.col("event_id").alias("seq"), F.row_number().over(own.orderBy(F.col("value").desc(), "event_id")).alias("_n"), F.greatest(F.count(F.lit(1)).over(own) - 5, F.lit(0).cast("long")).alias("hidden"))
    return rows.where("_n <= 5").select("tab", "seq", "hidden")


@query("wf10_first_errors", "select user_id as job_id, string_agg(event_id::varchar, ',' order by event_id) as errors from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as nth from events where event_type = 'error') where nth <= 5 group by 1")
def wf10(spark, d):
    rows = ad.table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("job_id"), "event_id")
    first = retention.keep_best(rows, ["job_id"], [F.col("event_id")], 5)
    return first.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("errors"))


_PLAN_KIND = "case l_suppkey % 5 when 0 then 'dash' when 1 then 'fragments' when 2 then 'direct' when 3 then 'muxed' else 'hls' end"


@query("wf12_choose_plan", f"""with p as (select l_orderkey as media_id, {_PLAN_KIND} as kind, l_linestatus = 'F' as runs, l_discount as confidence, l_linenumber::bigint as ord from lineitem),
r as (select *, case when kind = 'direct' and runs then 1 when kind = 'hls' then 2 when runs then 3 else 4 end as rnk, case kind when 'dash' then 0 when 'fragments' then 1 when 'direct' then 2 when 'muxed' then 3 else 4 end as step from p)
select media_id, kind, ord from (select *, row_number() over (partition by media_id order by rnk, case when kind = 'hls' then -confidence else 0 end, step, ord) as nth from r) where nth = 1""")
def wf12(spark, d):
    n = F.col("l_suppkey") % 5
    kind = F.when(n == 0, "dash").when(n == 1, "fragments").when(n == 2, "direct").when(n == 3, "muxed").otherwise("hls")
    plans = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), kind.alias("kind"), (F.col("l_linestatus") == "F").alias("executable"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").cast("long").alias("ord"))
    return cd.choose_plan(plans)


@query("a08_group_candidates", """with c as (select user_id as tab, event_type as key, event_id as seq, value as score, event_id % 3 as relevance, epoch_us(ts) as seen_at, case when event_id % 2 = 0 then 'audio' else 'video' end as role from events),
b as (select *, row_number() over (partition by tab, key order by relevance, score, seq) as nth, count(*) over (partition by tab, key) - 1 as hidden, count(*) filter (role = 'audio') over (partition by tab, key) as audio from c)
select tab, key, seq, hidden, audio, cast(row_number() over (partition by tab order by relevance, score, seen_at desc, seq) as int) as rank from b where nth = 1""")
def a08(spark, d):
    rows = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("score"), (F.col("event_id") % 3).alias("relevance"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen_at"), F.when(F.col("event_id") % 2 == 0, "audio").otherwise("video").alias("role"), F.lit("page").alias("source"), F.lit(0).alias("size"))
    return cd.group(rows).select("tab", "key", "seq", "hidden", "audio", "rank")


@query("sf08_similarity_keys", f"with {_MEDIA} select page_id, 'page-duration:' || (page_id % 9) || ':' || cast(cast(floor(page_id % 100 / 5e0 + 0.5) * 5 as bigint) as varchar) as key from pages where page_id % 100 > 0")
def sf08(spark, d):
    rows = _media(spark, d).where(F.col("page_id") % 100 > 0)
    key = cd.similarity_key((F.col("page_id") % 9).cast("string"), (F.col("page_id") % 100).cast("double"), F.lit("audio"), F.lit("audio"), F.col("u"))
    return rows.select("page_id", key.alias("key"))


@query("wf05_neighbour_gaps", ad.with_views(ad.EVENT_SEGMENTS) + "select media_id, ord, cast(floor((s - lag(e) over w) * 1000 + 0.5) as bigint) as gap_ms from ev window w as (partition by media_id order by s, e, ord)")
def wf05(spark, d):
    order = Window.partitionBy("media_id").orderBy("s", "e", "ord")
    return ad.event_segments(spark, d).select("media_id", "ord", F.floor((F.col("s") - F.lag("e").over(order)) * 1000 + 0.5).cast("long").alias("gap_ms"))
