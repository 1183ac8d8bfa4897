"""Queries of event sources, enriched candidates and their records. The driver's parts stand for events and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuetide.operators import assets, candidates
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.sources import events


def _part(spark, d):
    return ad.table(spark, d, "part").withColumn("k", F.col("p_partkey"))


def _pick(number, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _pick_sql(number: str, values: list) -> str:
    listed = ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{listed}])[({number}) % {len(values)} + 1]"


_URLS = ["https://h.example/a.mp3", "https://h.example/page", "https://cdn.plyr.io/static/blank.mp4", "https://h.example/v.m3u8?x=1", "https://h.example/data"]
_TYPES = ["", "audio/mpeg; q=1", "application/octet-stream", "text/html", "application/vnd.apple.mpegurl", "video/mp4"]
_EVENTS, _REQUESTS = ["request-headers", "request", "response"], ["media", "xmlhttprequest", "other", "image"]


@query("sc01_network_events", f"""with e as (select p_partkey as id, p_partkey % 11 - 1 as tab, {_pick_sql('p_partkey', _URLS)} as url, {_pick_sql('p_partkey // 5', _EVENTS)} as event, {_pick_sql('p_size', _REQUESTS)} as rt, {_pick_sql('p_size // 4', _TYPES)} as ct from part),
k as (select *, case p_partkey % 5 when 0 then 'audio' when 3 then 'hls' end as known from (select e.*, id as p_partkey from e)),
w as (select *, case when contains(ct, 'audio/') then 'audio' when contains(ct, 'mpegurl') then 'hls' else 'media' end as typed, ct in ('audio/mpeg; q=1', 'application/vnd.apple.mpegurl', 'video/mp4') as media from k)
select id, tab, event as source, coalesce(known, typed) as kind, case known when 'audio' then 'mp3' when 'hls' then 'm3u8' else '' end as ext from w
where tab >= 0 and id % 5 <> 2 and case event when 'request-headers' then known is not null when 'request' then known is not null and rt <> 'image' else rt <> 'image' and ct <> '' and (known is not null or media) end""")
def sc01(spark, d):
    k, size = F.col("k"), F.col("p_size")
    rows = _part(spark, d).select(k.alias("id"), (k % 11 - 1).alias("tab"), _pick(k, _URLS).alias("url"), _pick(F.floor(k / 5), _EVENTS).alias("event"), _pick(size, _REQUESTS).alias("request_type"), _pick(F.floor(size / 4), _TYPES).alias("content_type"))
    return events.network_events(rows).select("id", "tab", "source", "kind", "ext")


_PAGE_URLS = ["https://h.example/a.mp3", "blob:https://h/1", "data:audio/mp3;base64,AA", "https://h.example/x", "https://cdn.plyr.io/static/blank.mp4", "", "https://h.example/v.mpd"]


@query("sc02_page_events", f"""select p_partkey as id, coalesce(frame, 0) as frame, coalesce(nullif(src, ''), 'page') as source, coalesce(nullif(given, ''), case p_partkey % 7 when 0 then 'audio' when 6 then 'dash' end, 'media') as kind, case p_partkey % 7 when 0 then 'mp3' when 6 then 'mpd' else '' end as ext
from (select *, case when p_size % 2 = 0 then p_size::bigint end as frame, {_pick_sql('p_size', ['', 'media-element'])} as src, {_pick_sql('p_size', ['', 'video', 'audio'])} as given from part) where p_partkey % 3 > 0 and p_partkey % 7 in (0, 3, 6)""")
def sc02(spark, d):
    k, size = F.col("k"), F.col("p_size")
    rows = _part(spark, d).select(k.alias("id"), (k % 3).alias("tab"), F.when(size % 2 == 0, size.cast("long")).alias("frame"), _pick(k, _PAGE_URLS).alias("url"), _pick(size, ["", "video", "audio"]).alias("kind"), F.lit("").alias("ext"), _pick(size, ["", "media-element"]).alias("source"))
    return events.page_events(rows).select("id", "frame", "source", "kind", "ext")


@query("sc03_resource_timings", """with r as (select l_suppkey as tab, 'https://h.example/' || (l_partkey % 50) || case when l_partkey % 50 % 3 = 0 then '.mp3' when l_partkey % 50 % 3 = 1 then '.ts' else '.css' end as url, l_partkey % 50 % 3 as c, l_orderkey * 10 + l_linenumber as seen, case when l_tax > 0.04 then 0 else l_partkey end as a, case when l_discount > 0.05 then 0 else l_suppkey end as b, l_linenumber::bigint as z from lineitem)
select tab, url, case c when 0 then 'audio' else 'media' end as kind, coalesce(nullif(arg_min(a, seen), 0), nullif(arg_min(b, seen), 0), arg_min(z, seen)) as size from r where c < 2 group by tab, url, c""")
def sc03(spark, d):
    n = F.col("l_partkey") % 50
    ext = F.when(n % 3 == 0, ".mp3").when(n % 3 == 1, ".ts").otherwise(".css")
    rows = ad.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tab"), F.concat(F.lit("https://h.example/"), n.cast("string"), ext).alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_tax") > 0.04, 0).otherwise(F.col("l_partkey")).alias("transfer_size"), F.when(F.col("l_discount") > 0.05, 0).otherwise(F.col("l_suppkey")).alias("encoded_size"), F.col("l_linenumber").cast("long").alias("decoded_size"))
    return events.resource_timings(rows).select("tab", "url", "kind", "size")


_NESTED = "'{\"a\": [{\"b\": {\"url\": \"https://h/' || p_partkey || '.mp3\", \"mimeType\": \"audio/mpeg; c=1\", \"contentLength\": \"' || p_size || '\", \"backupUrl\": [\"https://h/b.mp4\", \"https://h/' || p_partkey || '.mp3\"]}}, {\"base_url\": \"https://h/plain\", \"mime\": \"text/html\"}], \"signatureCipher\": \"s=1&url=https%3A%2F%2Fh%2Fc.webm\", \"height\": ' || p_size || '}'"


@query("sc04_structured_media", f"""with p as (select p_partkey, p_size, {_NESTED} as j from part), t as (select p_partkey, p_size, unnest(['https://h/' || p_partkey || '.mp3', 'https://h/b.mp4', 'https://h/c.webm']) as url from p where json_valid(j))
select p_partkey as id, url, case when contains(url, 'c.webm') then 'media' else 'audio' end as kind, case when contains(url, 'c.webm') then null else p_size::bigint end as size, case when contains(url, 'c.webm') then p_size::bigint end as height, case when contains(url, 'c.webm') then 0 else 3 end as depth from t""")
def sc04(spark, d):
    """Objects within lists within objects; an address and its copy count once, and a page of text is no medium."""
    found = events.structured_media(_part(spark, d).select(F.col("p_partkey").alias("id"), F.expr(_NESTED).alias("payload")), "id")
    return found.select("id", "url", "kind", "size", "height", "depth")


# Candidates of tabs, a tab to each nation, whose key tells the length of its page's medium.
_C_URLS = ["https://h.example/a.mp3", "https://h.example/v.m3u8", "https://h.example/m.mp4", "https://h.example/s.m4s", "https://h.example/b.mp3", "https://h.example/data"]
_C_KINDS, _C_EXTS = ["audio", "hls", "media", "segment", "audio", "other"], ["mp3", "m3u8", "mp4", "m4s", "mp3", ""]


def _candidates(spark, d):
    k, size = F.col("k"), F.col("p_size")
    return _part(spark, d).select(
        k.alias("seq"), (k % 25).cast("int").alias("tab"), _pick(k, _C_URLS).alias("url"), _pick(k, _C_KINDS).alias("kind"), _pick(k, _C_EXTS).alias("ext"), F.lit("request").alias("source"), F.lit("").alias("content_type"),
        (size * 1_000_000).cast("long").alias("size"), F.when(k % 6 == 4, 30.0).alias("duration"), F.lit(None).cast("int").alias("video_width"), F.when(k % 4 == 0, size).alias("video_height"), F.lit(None).cast("long").alias("bandwidth"), F.lit("").alias("initiator"),
    )


def _tabs(spark, d):
    n = F.col("n_nationkey")
    return ad.table(spark, d, "nation").select(n.alias("tab"), F.lit("https://p.example/").alias("page_url"), F.col("n_name").alias("page_title"), (n * 60.0).alias("page_duration"), F.when(n % 3 == 0, 1280).alias("page_width"), F.when(n % 3 == 0, 720).alias("page_height"), (n % 2 == 0).alias("page_has_media"))


_CANDIDATES = f"""c as (select p_partkey as seq, p_partkey % 25 as tab, p_partkey % 6 as f, {_pick_sql('p_partkey', _C_URLS)} as url, p_size * 1000000 as size, case when p_partkey % 6 = 4 then 30e0 end as duration, case when p_partkey % 4 = 0 then p_size end as height from part),
t as (select n_nationkey as tab, n_nationkey * 60e0 as pd, n_nationkey % 3 = 0 as shaped, n_nationkey % 2 = 0 as has from nation),
i as (select c.*, pd, shaped, case when f in (1, 3, 4) then true when f = 0 then pd > 0 and size * 8 / pd between 48000 and 768000 and has when f = 2 then has and pd > 0 else false end as inherits from c join t using (tab)),
n as (select *, coalesce(duration, case when inherits then pd end) as seconds, case when f = 1 and shaped then 1280 end as w, coalesce(nullif(height, 0), case when f = 1 and shaped then 720 end) as h from i)"""


@query("f17_inherited_durations", "with " + _CANDIDATES + " select seq, inherits from i")
def f17(spark, d):
    both = _candidates(spark, d).join(_tabs(spark, d), "tab")
    return both.select("seq", assets.inherits_duration(F.col("page_duration"), F.col("page_has_media"), F.col("page_url")).alias("inherits"))


@query("p01_enriched_candidates", "with " + _CANDIDATES + """ select seq, seconds as duration, string_split(url, '/')[-1] as filename, case when f in (0, 4) then 'audio' when f = 1 then 'playlist' when w is not null and h is not null then 'video' else 'media' end as role,
case when w is not null and h is not null then w || 'x' || h else '' end as resolution, case when coalesce(pd, 0) <= 0 then 0e0 when coalesce(seconds, 0) <= 0 then 4e0 when abs(seconds - pd) <= greatest(2e0, least(12e0, pd * 0.03e0)) then 0e0 else 8 + least(abs(seconds - pd) / pd, 8e0) end as relevance from n""")
def p01(spark, d):
    found = assets.enrich(_candidates(spark, d), _tabs(spark, d))
    return found.select("seq", "duration", "filename", "role", "resolution", "relevance")


@query("p02_assets", "with " + _CANDIDATES + """ select seq, case f when 5 then 'unknown' when 0 then 'audio' when 4 then 'audio' when 1 then 'hls' when 2 then 'media' else 'segment' end as kind, seconds as duration, case when w > 0 and h > 0 then w || 'x' || h end as dimensions from (select * replace (case when seconds > 0 then seconds end as seconds) from n)""")
def p02(spark, d):
    rows = assets.enrich(_candidates(spark, d), _tabs(spark, d)).withColumns({"final_url": F.lit(""), "codecs": F.lit("")})
    a = assets.asset()
    shape = a["dimensions"]
    return rows.select("seq", a["kind"].alias("kind"), a["duration"].alias("duration"), F.when(shape.isNotNull(), F.concat_ws("x", shape["width"].cast("string"), shape["height"].cast("string"))).alias("dimensions"))


_INPUTS, _PLANS = ["hls", "dash", "mse-fragments", "direct", ""], ["hls", "muxed-media", "direct"]


def _plans(spark, d):
    k, size = F.col("k"), F.col("p_size")
    plan = assets.audio_plan(_pick(k, _PLANS), (size - 10) / F.lit(20.0), F.when(size % 4 == 0, False), _pick(size, _INPUTS))
    return _part(spark, d).select(k.alias("id"), plan.alias("plan"), (k % 2 == 0).alias("trusted"), F.when(k % 5 > 0, "https://h/x").otherwise("").alias("url"))


_PLAN = f"""pl as (select p_partkey as id, {_pick_sql('p_partkey', _PLANS)} as kind, greatest(0e0, least(1e0, (p_size - 10) / 20e0)) as confidence, p_size % 4 <> 0 as executable, {_pick_sql('p_size', _INPUTS)} as form from part),
st as (select *, case when form = 'hls' then 'hls-playlist' when form = 'dash' then 'dash-manifest' when form = 'mse-fragments' then 'fmp4-fragments' when kind = 'muxed-media' then 'muxed-media-file' else 'direct-audio-file' end as strategy from pl)"""


@query("p03_audio_plans", "with " + _PLAN + " select id, kind, confidence, executable, strategy, form in ('hls', 'dash', 'mse-fragments') as requires_assembly from st")
def p03(spark, d):
    return _plans(spark, d).select("id", "plan.kind", "plan.confidence", "plan.executable", "plan.strategy", "plan.requires_assembly")


@query("p02_evidence_lists", """with e as (select l_orderkey as id, l_linenumber as n, l_partkey as p, l_suppkey as sup, case when l_linenumber % 4 = 0 then '' when l_linenumber % 4 <> 3 then lower(l_returnflag) end as source, greatest(l_discount * 100 - 3, 0) as strength, case when l_suppkey % 3 = 0 then l_linestatus else '' end as detail from lineitem),
k as (select *, coalesce(source, '') || ':' || floor(strength + 0.5)::int || ':' || detail as said, detail || coalesce(source, '') || p % 2 as warning from e)
select id, coalesce(string_agg(said, ',' order by n, p, sup) filter (coalesce(source, '') <> '' or detail <> ''), '') as evidence, count(distinct detail || p % 2) as warnings, max(case when n % 3 <> 0 then 20e0 end) as strength from k group by 1""")
def p02_lists(spark, d):
    """What assets are known by: lines of orders as evidence and as warnings."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    source = F.when(n % 4 == 0, "").when(n % 4 != 3, F.lower("l_returnflag"))
    detail = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linestatus")).otherwise("")
    item = F.struct(source.alias("source"), (F.col("l_discount") * 100 - 3).alias("strength"), detail.alias("detail"))
    warning = F.struct(F.when(detail != "", detail).alias("code"), (p % 2).cast("string").alias("message"))
    told = assets.duration_evidence(source, n % 3, F.lit(None).cast("double"), F.lit(None).cast("string"))
    rows = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), p.alias("p"), F.col("l_suppkey").alias("sup"), item.alias("x"), warning.alias("w")))).alias("items"), F.max(told["strength"]).alias("strength"))
    evidence = assets.evidence_list(F.transform("items", lambda v: v["x"]))
    said = F.transform(evidence, lambda x: F.concat_ws(":", x["source"], F.floor(x["strength"] + 0.5).cast("string"), x["detail"]))
    return rows.select("id", F.array_join(said, ",").alias("evidence"), F.size(assets.warning_list(F.transform("items", lambda v: v["w"]))).cast("long").alias("warnings"), "strength")


@query("p03_plan_relations", """with l as (select l_orderkey as plan, l_partkey as asset, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as pos from lineitem),
o as (select plan, asset, min(case when pos = 0 and plan % 7 = 0 then null else pos end) as pos from l group by 1, 2)
select plan, asset, case when pos = 0 then 'primary' else 'companion' end as relation, pos, p_partkey is not null as found from o left join (select p_partkey from part where p_size > 5) on p_partkey = asset where pos is not null""")
def p03_relations(spark, d):
    """Orders as plans: the part of the first line is the primary asset (every seventh plan has none), the others go along."""
    lines = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("parts"))
    plans = lines.select("plan", F.when(F.col("plan") % 7 != 0, F.element_at("parts", 1)).alias("primary"), F.slice("parts", 2, F.size("parts")).alias("companions"))
    return assets.plan_relations(plans, ad.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("asset")))


@query("p17_executions", "with " + _PLAN + " select id, case when id % 2 = 1 then 'untrusted' when not executable then 'not executable' when id % 5 = 0 then 'no url' end as reason, case when id % 2 = 0 and executable and id % 5 > 0 then strategy end as strategy from st")
def p17(spark, d):
    runs, not_runs = assets.execution(_plans(spark, d))
    return runs.select("id", F.lit(None).cast("string").alias("reason"), F.col("input.strategy").alias("strategy")).unionByName(not_runs.select("id", "reason", F.lit(None).cast("string").alias("strategy")))


@query("p04_without_secrets", "select p_partkey as id, 'id,url,variants' as names, '{\"url\":\"v' || p_size || '\"}' as variant from part")
def p04(spark, d):
    """What is left of columns and of a variant's fields."""
    variant = F.struct(F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("url"), F.lit("cookie").alias("request_headers"))
    rows = _part(spark, d).select(F.col("k").alias("id"), F.lit("u").alias("url"), F.lit("cookie").alias("request_headers"), F.lit("p").alias("source_plan"), F.array(variant).alias("variants"))
    safe = assets.without_secrets(rows)
    return safe.select("id", F.lit(",".join(sorted(safe.columns))).alias("names"), F.to_json(F.col("variants")[0]).alias("variant"))


@query("p06_summaries", "with " + _CANDIDATES + " select seq % 25 as tab, count(*) as shown, count(distinct filename) as files, cast(sum(size) as bigint) as bytes from (select *, string_split(url, '/')[-1] as filename from n) group by 1")
def p06(spark, d):
    shown = assets.summary(assets.enrich(_candidates(spark, d), _tabs(spark, d)))
    return shown.groupBy("tab").agg(F.count(F.lit(1)).alias("shown"), F.count_distinct("filename").alias("files"), F.sum("size").alias("bytes"))


@query("p19_profiles", "with dflt as (select n_nationkey as id, n_regionkey as ord, n_name as name from nation where n_nationkey < 15), sto as (select p_size as id, min(p_partkey) as ord, arg_min(p_name, p_partkey) as name from part where p_size < 30 group by 1) select coalesce(d.id, s.id)::bigint as id, d.id is null as own, coalesce(d.ord, s.ord) as ord, coalesce(s.name, d.name) as name from dflt d full join sto s on d.id = s.id")
def p19(spark, d):
    defaults = ad.table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.lit("").alias("value"))
    stored = _part(spark, d).where("p_size < 30").select(F.col("p_size").cast("long").alias("id"), F.col("k").alias("ord"), F.col("p_name").alias("name"), F.lit("").alias("value"))
    return assets.merged_profiles(defaults, stored).select("id", "own", "ord", "name")


_M1, _M2 = "https://video.twimg.com/amplify_video/11/vid/avc1/a.mp4", "https://pbs.twimg.com/amplify_video_thumb/22/x.jpg"


@query("f02_displayable_groups", """with g as (select p_partkey as id, p_partkey % 4 as u, p_size % 3 as p, p_size % 2 as m, p_partkey % 5 as w from part)
select id, not (m = 1 and u in (0, 1) and u <> 1) and case when p = 0 then u <> 0 else p <> 1 and w > 0 end as shown from g""")
def f02(spark, d):
    k, size = F.col("k"), F.col("p_size")
    url = _pick(k, [_M1, _M2, "https://h/a.mp3", "https://h/b.mpd"])
    warnings = F.when(k % 5 == 0, F.array(F.lit("requires-signature-deciphering"))).otherwise(F.array(F.lit("other")))
    page = assets.media_number(F.when(size % 2 == 1, F.lit("https://pbs.twimg.com/amplify_video_thumb/22/y.jpg")).otherwise(F.lit("")))
    shown = assets.is_displayable(url, F.array().cast("array<string>"), size % 3 > 0, size % 3 != 1, warnings, page)
    return _part(spark, d).select(k.alias("id"), shown.alias("shown"))


_CODECS = ["avc1.64, mp4a.40", "avc1", "", "opus", "vp9,av01"]


@query("f16_muxed_files", f"""with c as (select p_partkey as id, {_pick_sql('p_partkey', ['media', 'audio', 'hls', 'other'])} as kind, {_pick_sql('p_size', ['mp4', 'm4s', 'bin', 'webm'])} as ext, {_pick_sql('p_size // 4', ['', 'video/mp4'])} as ct, {_pick_sql('p_partkey // 4', _CODECS)} as codecs from part)
select id, kind not in ('hls', 'audio') and ext <> 'm4s' and codecs not in ('avc1', 'vp9,av01') and (ext in ('mp4', 'webm') or ct <> '' or kind = 'media') as muxed from c""")
def f16(spark, d):
    k, size = F.col("k"), F.col("p_size")
    muxed = assets.is_direct_muxed(_pick(k, ["media", "audio", "hls", "other"]), F.lit("other"), _pick(size, ["mp4", "m4s", "bin", "webm"]), _pick(F.floor(size / 4), ["", "video/mp4"]), F.lit("https://h/x"), _pick(F.floor(k / 4), _CODECS))
    return _part(spark, d).select(k.alias("id"), muxed.alias("muxed"))


@query("f20_video_only_variants", f"select p_partkey as id, p_size % 3 > 0 and p_size % 5 > 0 and p_size % 7 > 0 and {_pick_sql('p_partkey', _CODECS)} in ('avc1', 'vp9,av01') as video_only from part")
def f20(spark, d):
    k, size = F.col("k"), F.col("p_size")
    alone = assets.is_variant_video_only(F.when(size % 3 > 0, "1x1"), _pick(k, _CODECS), size % 5 == 0, F.when(size % 7 == 0, "g"))
    return _part(spark, d).select(k.alias("id"), alone.alias("video_only"))


_LISTS = ["https://h.example/x/video/a.m3u8?t=1", "https://h.example/q/video.m3u8", "https://h.example/index-f9-v2.m3u8", "https://video.twimg.com/e/pl/avc1/720x1280/k.m3u8", "https://h.example/a.mp3"]
_FOUND = ["https://h.example/x/audio/a.m3u8?t=1", "https://h.example/q/audio.m3u8", "https://h.example/index-f8-a2.m3u8 https://h.example/index-f9-a2.m3u8 https://h.example/index-f9-a1.m3u8", "https://video.twimg.com/e/pl/mp4a/128000/k.m3u8 https://video.twimg.com/e/pl/mp4a/64000/k.m3u8 https://video.twimg.com/e/pl/mp4a/32000/k.m3u8", ""]


@query("sf12_audio_companions", f"select p_partkey as id, {_pick_sql('p_partkey', _FOUND)} as found from part")
def sf12(spark, d):
    return _part(spark, d).select(F.col("k").alias("id"), F.array_join(assets.audio_companions(_pick(F.col("k"), _LISTS)), " ").alias("found"))


_SIDES = ["", "p1", "p2"]


@query("j19_cache_matches", f"""with c as (select p_partkey as id, {_pick_sql('p_partkey', _SIDES)} as page, {_pick_sql('p_partkey // 3', _SIDES)} as src, {_pick_sql('p_partkey // 9', _SIDES)} as ep, {_pick_sql('p_partkey // 27', _SIDES)} as es, {_pick_sql('p_size', _SIDES)} as mp, {_pick_sql('p_size // 3', _SIDES)} as ms from part)
select id, not (mp <> '' and page <> '' and mp <> page) and not (mp <> '' and ep <> '' and mp <> ep) and not (ms <> '' and src <> '' and ms <> src) and not (ms <> '' and es <> '' and ms <> es)
  and case when src <> '' then es = src and not (page <> '' and ep <> '' and page <> ep) else page <> '' and ep = page end as matches from c""")
def j19(spark, d):
    k, size = F.col("k"), F.col("p_size")
    third = lambda n, c: _pick(F.floor(c / n), _SIDES)
    fits = assets.cache_entry_matches(third(1, k), third(3, k), third(9, k), third(27, k), third(1, size), third(3, size))
    return _part(spark, d).select(k.alias("id"), fits.alias("matches"))


@query("j21_same_source", """with s as (select l_orderkey as media_id, l_linenumber::bigint as pos, case when l_linenumber % 2 = 0 then 'k' || (l_linenumber // 3) end as key, (l_linenumber // 2) * 10e0 as s, (l_linenumber // 2) * 10e0 + 1 as e from lineitem),
t as (select media_id, pos + 100 as pos, case when pos % 3 = 0 then 'k' || (pos // 3) end as key, s + 0.0005e0 as s, e - 0.0005e0 as e from s)
select t.media_id, t.pos, coalesce(min(s.pos), -1) as source_pos from t left join s on s.media_id = t.media_id and case when t.key is not null and s.key is not null then t.key = s.key else abs(t.s - s.s) < 0.001 and abs(t.e - s.e) < 0.001 end group by 1, 2""")
def j21(spark, d):
    n = F.col("l_linenumber").cast("long")
    start = F.floor(n / 2) * 10.0
    src = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media_id"), n.alias("pos"), F.when(n % 2 == 0, F.concat(F.lit("k"), F.floor(n / 3).cast("string"))).alias("key"), start.alias("s"), (start + 1).alias("e"))
    tra = src.select("media_id", (F.col("pos") + 100).alias("pos"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("k"), F.floor(F.col("pos") / 3).cast("string"))).alias("key"), (F.col("s") + 0.0005).alias("s"), (F.col("e") - 0.0005).alias("e")).distinct()
    return assets.same_source_segments(tra, src)


@query("iv20_fragment_groups", """with f as (select l_orderkey as page, l_linenumber as n, l_linenumber = 1 as is_init, case when l_orderkey % 4 = 0 then 'unknown' when l_orderkey % 2 = 0 then 'audio' else 'video' end as role, case when l_orderkey % 5 > 0 then 4e0 end as duration from lineitem),
g as (select page, any_value(role) as role, count(*) as fragments, count(*) filter (is_init) as i, count(*) filter (not is_init) as m, count(duration) as t, count(distinct n) filter (not is_init) as dn, max(n) filter (not is_init) - min(n) filter (not is_init) + 1 as span from f group by 1)
select page, role, fragments, case when i = 0 then 'no init' when m < 2 then 'too few' when t = 0 then 'no timeline' when role = 'unknown' then 'role' when not (dn = m and span = m) then 'gaps' end as reason from g""")
def iv20(spark, d):
    """Lines of an order as fragments, the first one the init."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    name = F.concat(F.lit("https://h.example/o"), o.cast("string"), F.lit("/s-"), n.cast("string"), F.lit(".m4s"))
    role = F.when(o % 4 == 0, None).when(o % 2 == 0, "audio").otherwise("video")
    rows = ad.table(spark, d, "lineitem").select(o.alias("page"), name.alias("url"), F.lit("").alias("track"), role.alias("role"), (n == 1).alias("is_init"), n.alias("number"), F.when(o % 5 > 0, 4.0).alias("duration"), n.alias("ord"))
    return assets.best_fragments(rows).select("page", "role", "fragments", "reason")


@query("wf04_group_order", "select user_id as tab, event_id as seq, row_number() over (partition by user_id order by event_id % 3, value, event_id desc) as place from events")
def wf04(spark, d):
    """A tab's groups in their total order: relevance, score, the newest."""
    e = ad.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("tab"), F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("relevance"), F.col("value").alias("score"), F.lit("response").alias("source"), F.lit(0).alias("size"), F.lit("audio").alias("role"), F.col("event_id").alias("seen_at"))
    return candidates.group(rows).select("tab", "seq", F.col("rank").cast("long").alias("place"))
