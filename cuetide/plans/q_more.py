"""Queries of players' payloads, batches, retries and the remaining joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuetide.functions import text as tx
from cuetide.functions import urls
from cuetide.functions.times import millis
from cuetide.operators import candidates as cd
from cuetide.operators import export, folds, intervals, jobs, runs
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_joins import plain_sql
from cuetide.plans.q_runs import key_sql
from cuetide.sources import manifests, players

EV, SP, SG = ad.EVENT_SEGMENTS, ad.SPEECH, ad.VIEWS
_MS = lambda c: f"cast(floor(({c}) * 1000 + 0.5) as bigint)"


def _part(spark, d):
    return ad.table(spark, d, "part")


@query("sc24_playinfo_assets", "select p_partkey as page_id, 'audio' as role, n as place, 'u' || case n when 0 then '' else 'b' end || p_size as url, p_size * 1000::bigint as bitrate from part, range(2) r(n) union all select p_partkey, 'video', 0, 'v', null from part")
def sc24(spark, d):
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit('{"data": {"dash": {"duration": 9, "audio": [{"baseUrl": "u'), size, F.lit('", "backupUrl": ["ub'), size, F.lit('", "u'), size, F.lit('"], "bandwidth": '), (F.col("p_size") * 1000).cast("string"), F.lit('}], "video": [{"base_url": "v"}]}}}'))
    found = players.playinfo_assets(_part(spark, d).select(F.col("p_partkey").alias("page_id"), body.alias("payload")))
    return found.select("page_id", "role", F.col("place").cast("long").alias("place"), "url", "bitrate")


@query("sc25_player_formats", "select p_partkey as page_id, 'https://h/' || p_size || '?a=1' as url, 'audio' as role, 'opus' as codecs, p_size % 2 = 1 as needs_deciphering from part")
def sc25(spark, d):
    """Formats with plain and with ciphered URLs."""
    size = F.col("p_size").cast("string")
    plain = F.concat(F.lit('"url": "https://h/'), size, F.lit('?a=1"'))
    cipher = F.concat(F.lit('"signatureCipher": "s=x&url=https%3A%2F%2Fh%2F'), size, F.lit('%3Fa%3D1"'))
    body = F.concat(F.lit('{"streamingData": {"adaptiveFormats": [{"mimeType": "audio/webm; codecs=\\"opus\\"", '), F.when(F.col("p_size") % 2 == 1, cipher).otherwise(plain), F.lit("}]}}"))
    found = players.player_formats(_part(spark, d).select(F.col("p_partkey").alias("page_id"), body.alias("payload")))
    return found.select("page_id", "url", "role", "codecs", "needs_deciphering")


@query("sc26_post_videos", "select p_partkey as post_id, n as bitrate, p_size / 2e0 as duration, p_size as width from part, range(2) r(n)")
def sc26(spark, d):
    body = F.concat(F.lit('{"media": [{"video_info": {"duration_millis": '), (F.col("p_size") * 500).cast("string"), F.lit(', "variants": [{"url": "a", "bitrate": 0}, {"url": "b", "bitrate": 1}]}, "sizes": {"large": {"w": 0, "h": 5}, "small": {"w": '), F.col("p_size").cast("string"), F.lit(', "h": 9}}}]}'))
    return players.post_videos(_part(spark, d).select(F.col("p_partkey").alias("post_id"), body.alias("payload"))).select("post_id", "bitrate", "duration", "width")


@query("sc21_sentence_payloads", "select p_partkey as chunk_id, (100 + p_size) * 1000::bigint as s_ms, 'hi' as text from part where p_size < 30 + 1.5")
def sc21(spark, d):
    """Sentences in milliseconds, kept about a core of thirty seconds."""
    ms = (F.col("p_size") * 1000).cast("string")
    body = F.concat(F.lit('{"transcripts": [{"sentences": [{"begin_time": '), ms, F.lit(', "end_time": '), (F.col("p_size") * 1000 + 900).cast("string"), F.lit(', "text": "hi"}]}]}'))
    chunks = _part(spark, d).select(F.col("p_partkey").alias("chunk_id"), body.alias("payload"), F.lit(100.0).alias("start"), F.lit(100.0).alias("core_s"), F.lit(130.0).alias("core_e"))
    return players.sentence_payloads(chunks).select("chunk_id", millis(F.col("s")).alias("s_ms"), "text")


@query("sc22_activity_payloads", "select p_partkey as chunk_id, case when p_size % 3 = 0 then null when p_size % 3 = 1 then 0 else 1 end as n from part")
def sc22(spark, d):
    """No list, an empty list, and one interval."""
    k = F.col("p_size") % 3
    body = F.when(k == 0, '{"x": 1}').when(k == 1, '{"segments": []}').otherwise('[{"start": 1000, "end": 9000}]')
    chunks = _part(spark, d).select(F.col("p_partkey").alias("chunk_id"), body.alias("payload"), F.lit(0.0).alias("start"), F.lit(30.0).alias("end"))
    n = F.size("intervals")
    return players.activity_payloads(chunks).select("chunk_id", F.when(F.col("intervals").isNotNull(), n).alias("n"))


@query("sc27_mp4_roles", "select p_partkey as id, case p_size % 3 when 0 then 'audio' when 1 then 'video' end as role from part")
def sc27(spark, d):
    def box(name: str, body: str) -> str:
        return f"{8 + len(body) // 2:08x}{name.encode().hex()}{body}"

    def head(*kinds: str) -> str:
        return box("ftyp", "00" * 4) + box("moov", "".join(box("trak", box("mdia", box("hdlr", "00" * 8 + k.encode().hex() + "00" * 4))) for k in kinds))

    k = F.col("p_size") % 3
    data = F.when(k == 0, head("soun")).when(k == 1, head("vide")).otherwise(head("soun", "vide"))
    return _part(spark, d).select(F.col("p_partkey").alias("id"), F.unhex(data).alias("c")).select("id", players.mp4_role(F.col("c")).alias("role"))


@query("f22_payload_heads", "select p_partkey as id, case p_size % 4 when 0 then 'mp3' when 1 then 'wav' when 2 then 'text' end as head from part")
def f22(spark, d):
    k = F.col("p_size") % 4
    data = F.when(k == 0, "494433040000").when(k == 1, "524946460000000057415645").when(k == 2, "0A207B2261223A317D").otherwise("0001020304")
    return _part(spark, d).select(F.col("p_partkey").alias("id"), F.unhex(data).alias("c")).select("id", players.audio_head(F.col("c")).alias("head"))


@query("sc31_page_durations", "select page_id, case page_id % 3 when 0 then 90e0 when 1 then 61.5e0 end as seconds from pages")
def sc31(spark, d):
    """Durations of meta tags, else of JSON-LD, put before the pages' markup."""
    k = F.col("page_id") % 3
    extra = F.when(k == 0, '<meta property="video:duration" content="90">').when(k == 1, '<script type="application/ld+json">{"duration": "PT1M1.5S"}</script>').otherwise("")
    return ad.table(spark, d, "pages").select("page_id", players.page_duration(F.concat(extra, "html")).alias("seconds"))


@query("sf07_family_paths", "select page_id, '/{resolution}-{track}/s-' || page_id || '.m4s' as family from pages")
def sf07(spark, d):
    u = F.concat(F.lit("http://h/1920x1080/v1/s-"), F.col("page_id").cast("string"), F.lit(".m4s"))
    return ad.table(spark, d, "pages").select("page_id", urls.family_path(u).alias("family"))


@query("sf11_audio_bitrates", "select l_orderkey, l_linenumber::bigint as line, cast(floor(case when l_tax > 0.05 then 96000 when l_discount > 0.05 and l_partkey > 0 then l_partkey else l_extendedprice * 8 / l_quantity end + 0.5) as bigint) as rate from lineitem")
def sf11(spark, d):
    """Of the URL, as stated, or from size and duration."""
    rate = cd.audio_bitrate(F.when(F.col("l_tax") > 0.05, 96000), F.when(F.col("l_discount") > 0.05, F.col("l_partkey")), F.col("l_extendedprice"), F.col("l_quantity"))
    return ad.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.floor(rate + 0.5).cast("long").alias("rate"))


@query("sf15_resolved_urls", "with h as (select page_id, url, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) as href from pages union all select page_id, url, unnest(['a/../b', './c?x=1', '//other.org/d', '?q', '#f', 'https://e.org/', '../../../g', '']) from pages), p as (select *, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) as origin, regexp_extract(url, '^([A-Za-z]+:)', 1) as scheme, regexp_replace(coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/'), '[^/]*$', '') as dir, regexp_replace(url, '#.*$', '') as nofrag, regexp_replace(url, '[?#].*$', '') as bare from h) select page_id, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then scheme || href when href = '' then nofrag when starts_with(href, '#') then nofrag || href when starts_with(href, '?') then bare || href when starts_with(href, '/') then origin || href when href = 'a/../b' then origin || dir || 'b' when href = './c?x=1' then origin || dir || 'c?x=1' when href = '../../../g' then origin || case when length(dir) - length(replace(dir, '/', '')) > 4 then regexp_replace(dir, '[^/]*/[^/]*/[^/]*/$', '') else '/' end || 'g' else origin || dir || href end as target, count(*) as n from p group by 1, 2")
def sf15(spark, d):
    """All links and sources of pages, and one reference of each form, joined with their page's URL."""
    forms = F.array(*[F.lit(x) for x in ("a/../b", "./c?x=1", "//other.org/d", "?q", "#f", "https://e.org/", "../../../g", "")])
    named = F.concat(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?:href|src)="([^"]*)"'), 1), forms)
    links = ad.table(spark, d, "pages").select("page_id", "url", F.explode(named).alias("href"))
    return links.select("page_id", urls.resolve(F.col("url"), F.col("href")).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("sf16_attribute_lists", "select p_partkey as id, p_size::varchar as bandwidth, 'a,' || p_size as name from part")
def sf16(spark, d):
    line = F.concat(F.lit('bandwidth=1,BANDWIDTH='), F.col("p_size").cast("string"), F.lit(',NAME="a,'), F.col("p_size").cast("string"), F.lit('",X='))
    a = manifests.attributes(line)
    return _part(spark, d).select(F.col("p_partkey").alias("id"), a["BANDWIDTH"].alias("bandwidth"), a["NAME"].alias("name"))


@query("sf17_codecs", "select p_partkey as id, p_size % 3 = 0 as audio_only, case when p_size % 2 = 0 then 'fmp4' else 'ts' end as container from part")
def sf17(spark, d):
    codecs = F.when(F.col("p_size") % 3 == 0, "mp4a.40.2, opus").when(F.col("p_size") % 3 == 1, "avc1,mp4a").otherwise("")
    name = F.when(F.col("p_size") % 2 == 0, "http://h/a.M4S?x=.ts").otherwise("a.ts")
    return _part(spark, d).select(F.col("p_partkey").alias("id"), urls.codecs_are_audio(codecs).alias("audio_only"), urls.container_hint(name).alias("container"))


@query("sf24_seconds_or_millis", "select event_id, case when abs(value * 100) >= 1000 then value * 100 / 1000 else value * 100 end as seconds from events")
def sf24(spark, d):
    return ad.table(spark, d, "events").select("event_id", players.seconds_or_millis(F.col("value") * 100).alias("seconds"))


@query("a07_merged_headers", "select user_id as tab, event_type as name, arg_max(value, event_id) as value from events group by 1, 2")
def a07(spark, d):
    rows = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), "event_id", F.create_map("event_type", "value").alias("headers"))
    return jobs.merge_headers(rows, ["tab"], ["event_id"]).select("tab", F.explode("headers").alias("name", "value"))


@query("a19_tab_context", "select user_id as tab, arg_max(event_id, struct_pack(v := value, i := event_id)) as largest, arg_max(event_type, event_id) filter (event_type <> 'error') as title from events group by 1")
def a19(spark, d):
    """The largest element's event, and the last text that is one."""
    rows = ad.table(spark, d, "events")
    return rows.groupBy(F.col("user_id").alias("tab")).agg(F.max_by("event_id", F.struct("value", "event_id")).alias("largest"), F.max_by("event_type", F.when(F.col("event_type") != "error", F.col("event_id"))).alias("title"))


@query("so01_union_of_attempts", "select media_id, count(*) as n from (select distinct media_id, ord from (select user_id as media_id, event_id as ord from events)) group by 1")
def so01(spark, d):
    """Two attempts with the same rows: joined, duplicates merge into one again, and rows without length stay two."""
    ev = ad.event_segments(spark, d).withColumn("text", F.concat_ws("-", "text", "ord"))
    both = ev.unionByName(ev.withColumn("ord", F.col("ord") + 10_000_000))
    merged = folds.merge_duplicates(both)
    return merged.groupBy("media_id").agg(F.count_distinct("text").alias("n"))


@query("f18_rows_in_gaps", ad.with_views(EV, SP, SG) + "select media_id, ord from sg where exists (select 1 from sp where sp.media_id = sg.media_id and least(sg.e, sp.e + 0.2e0) - greatest(sg.s, sp.s - 0.2e0) > 0 and least(sg.e, sp.e + 0.2e0) - greatest(sg.s, sp.s - 0.2e0) >= least(0.35e0, greatest(0.08e0, (sg.e - sg.s) * 0.25e0)))")
def f18(spark, d):
    """Rows that reach into gaps; the gaps are the speech intervals here."""
    rows, none = ad.views(spark, d), ad.views(spark, d).limit(0)
    repeated = runs.repeated_keys(none, tx.repeat_key(F.col("text")))
    return jobs.retry_rows(none, rows, ad.speech(spark, d), repeated, tx.repeat_key(F.col("text"))).select("media_id", "ord")


@query("f21_retry_rows", ad.with_views(EV, SP, SG) + f""", rp as (select media_id, {key_sql('text')} as k from sg where length({key_sql('text')}) >= 6 group by 1, 2 having count(*) >= 2 and max(e) - min(s) >= 6)
select media_id, ord from sg where {key_sql('text')} not in (select k from rp where rp.media_id = sg.media_id) and exists (select 1 from sp where sp.media_id = sg.media_id and least(sg.e, sp.e + 0.2e0) - greatest(sg.s, sp.s - 0.2e0) > 0 and least(sg.e, sp.e + 0.2e0) - greatest(sg.s, sp.s - 0.2e0) >= least(0.35e0, greatest(0.08e0, (sg.e - sg.s) * 0.25e0)))""")
def f21(spark, d):
    rows, none = ad.views(spark, d), ad.views(spark, d).limit(0)
    key = tx.repeat_key(F.col("text"))
    return jobs.retry_rows(none, rows, ad.speech(spark, d), runs.repeated_keys(rows, key), key).select("media_id", "ord")


@query("j20_context_segments", ad.with_views(EV, SP, SG) + "select sp.media_id, sp.idx, count(*) as n from sp join sg on sg.media_id = sp.media_id and sg.s < sp.e + 2 and sp.s - 2 < sg.e group by 1, 2")
def j20(spark, d):
    """Segments about a group, two seconds of context on either side."""
    groups = ad.speech(spark, d).select("media_id", "idx", F.col("s").alias("rs"), F.col("e").alias("re"))
    return intervals.overlap_join(ad.views(spark, d), groups, slack=2.0).groupBy("media_id", "idx").agg(F.count(F.lit(1)).alias("n"))


@query("j23_same_page", "select a.page_id as job, count(*) as pages from (select page_id, regexp_extract(lower(url), '^([a-z]+://[^/?#]*)', 1) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as p from pages) a join (select regexp_extract(lower(url), '^([a-z]+://[^/?#]*)', 1) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as p from pages) b using (p) group by 1")
def j23(spark, d):
    """Jobs and the pages that are their page."""
    pages = ad.table(spark, d, "pages").select("page_id", urls.page_identity(F.col("url")).alias("p"))
    sizes = pages.groupBy("p").agg(F.count(F.lit(1)).alias("pages"))
    return pages.join(sizes, "p").select(F.col("page_id").alias("job"), "pages")


@query("sk06_job_reports", "select o_custkey as job_id, count(*) as chunks from orders group by 1")
def sk06(spark, d):
    """Reports as JSON, read again to count their chunks; no token stays."""
    rows = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("stage"), F.concat(F.lit("failed with token=abc "), "o_orderpriority").alias("message"))
    found = jobs.report_json(rows)
    return found.where("not contains(report, 'abc')").select("job_id", F.json_array_length(F.get_json_object("report", "$.chunks")).cast("long").alias("chunks"))


@query("ud02_translation_batches", ad.with_views(ad.TURNS) + ", n as (select media_id, ord, row_number() over (partition by media_id order by s, e, ord) - 1 as n from tn) select media_id, n // 4 as batch, count(*) as rows_n from n group by 1, 2")
def ud02(spark, d):
    return jobs.batches(ad.turns(spark, d), 4).groupBy("media_id", "batch").agg(F.count(F.lit(1)).alias("rows_n"))


@query("ud03_translated_batches", ad.with_views(ad.TURNS) + f", n as (select *, row_number() over (partition by media_id order by s, e, ord) - 1 as n from tn) select media_id, (n // 4) as batch, (n % 4)::bigint as pos, case when length(text) % 7 = 0 then text else lower(text) end as text, length(text) % 7 = 0 as failed from n where {plain_sql('text')} <> ''")
def ud03(spark, d):
    """A client that lower-cases, returns short answers for longer batches, and fails on some texts."""

    def client(texts: list[str]) -> list[dict]:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("cannot")
        return [{"i": i, "text": t.lower()} for i, t in enumerate(texts)]

    return jobs.translate(jobs.batches(ad.turns(spark, d), 4), client)


@query("st14_recompute_bucket", "select o_custkey as job, o_orderkey as chunk, case when o_custkey % 5 = 0 then 'fresh' else o_orderstatus end as text from orders")
def st14(spark, d):
    rows = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("chunk"), F.col("o_orderstatus").alias("text"))
    return jobs.recompute_bucket(rows, rows.where("job % 5 = 0").withColumn("text", F.lit("fresh")), ["job"])


@query("sk08_local_playlists", """with s as (select l_orderkey as m, l_linenumber * 100000000 + l_partkey * 100 + l_suppkey % 100 as o, l_quantity / 7 as d, 'seg-' || l_partkey || '.ts' as name, case when l_linenumber > 1 then 'init-' || (l_linenumber // 4) || '.mp4' end as map, case when l_linenumber % 4 > 1 then 'METHOD=AES-128,URI="k.bin"' end as key, l_linenumber = 3 as disc from lineitem),
w as (select *, row_number() over t as n, lag(map) over t as map0, lag(key) over t as key0 from s window t as (partition by m order by o, d))
select m as media, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || greatest(1, ceil(max(d))::bigint) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || string_agg(case when disc then '#EXT-X-DISCONTINUITY' || chr(10) else '' end || case when map is not null and (n = 1 or map is distinct from map0) then '#EXT-X-MAP:URI="' || map || '"' || chr(10) else '' end
  || case when (n = 1 and key is not null) or (n > 1 and key is distinct from key0) then '#EXT-X-KEY:' || coalesce(key, 'METHOD=NONE') || chr(10) else '' end || '#EXTINF:' || d::decimal(18,6) || ',' || chr(10) || name, chr(10) order by o, d) || chr(10) || '#EXT-X-ENDLIST' || chr(10) as playlist from w group by 1""")
def sk08(spark, d):
    """Segments as playlists, with maps and keys that come and go."""
    n = F.col("l_linenumber")
    rows = ad.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), (n * F.lit(100_000_000).cast("long") + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("ord"), (F.col("l_quantity") / 7).alias("seconds"), F.concat(F.lit("seg-"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("name"),
        F.when(n > 1, F.concat(F.lit("init-"), F.floor(n / 4).cast("string"), F.lit(".mp4"))).alias("map_name"), F.when(n % 4 > 1, 'METHOD=AES-128,URI="k.bin"').alias("key_line"), (n == 3).alias("discontinuity"),
    )
    return export.to_playlist(rows).withColumnRenamed("media_id", "media")


@query("sc30_segment_files", "select l_orderkey as media, l_linenumber::bigint as idx, l_linenumber * 900::bigint as start_s from lineitem")
def sc30(spark, d):
    """Files named by a pattern: their number, and with it their start."""
    name = F.concat(F.lit("/x/out-"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(".mp3"))
    n = F.regexp_extract(name, r"-(\d+)\.[a-z0-9]+$", 1).cast("long")
    return ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("media"), n.alias("idx"), (n * 900).alias("start_s"))


@query("wf13_site_plans", "select l_orderkey as media_id, arg_min(l_linenumber::bigint, struct_pack(p := case l_suppkey % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end, d := abs(l_partkey * 100 - 132000), o := l_linenumber)) as ord, 'site' as kind from lineitem group by 1")
def wf13(spark, d):
    """Plans of a site's own tracks, which outrank all others."""
    track = F.element_at(F.array(*[F.lit(t) for t in (*cd.SITE_TRACKS, "99")]), (F.col("l_suppkey") % (len(cd.SITE_TRACKS) + 1) + 1).cast("int"))
    best = F.min_by(F.col("l_linenumber").cast("long"), F.struct(cd.site_track_preference(track), F.abs(F.col("l_partkey") * 100 - 132_000), F.col("l_linenumber")))
    site = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(best.alias("ord")).withColumns({"kind": F.lit("site"), "executable": F.lit(True), "confidence": F.lit(0.95)})
    other = site.withColumns({"kind": F.lit("direct"), "ord": F.col("ord") + 100})
    return cd.choose_plan(site.unionByName(other)).select("media_id", "ord", "kind")


@query("p12_chunk_times", "select p_partkey as chunk_id, case when p_size % 2 = 0 then 1005 else 1003 end * 1000::bigint as s_ms from part")
def p12(spark, d):
    """Times from the chunk's start, or absolute already."""
    from cuetide.sources import speech

    absolute = F.col("p_size") % 2 == 0
    start = F.when(absolute, 1005.0).otherwise(3.0)
    rows = _part(spark, d).select(F.col("p_partkey").alias("chunk_id"), F.lit(0).cast("long").alias("ord"), start.alias("s"), (start + 1).alias("e"), F.array().cast("array<struct<start:double,end:double,text:string,probability:double>>").alias("words"))
    chunks = _part(spark, d).select(F.col("p_partkey").alias("chunk_id"), F.lit(1000.0).alias("start"), F.lit(1030.0).alias("end"))
    return speech.chunk_times(rows, chunks).select("chunk_id", millis(F.col("s")).alias("s_ms"))
