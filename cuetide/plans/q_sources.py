"""Queries of the readers, over files made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.functions.text import clean_plain
from cuetide.functions.times import millis
from cuetide.operators import export
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_joins import plain_sql
from cuetide.sources import manifests, speech, subtitles

_CUES = ad.with_views(ad.DOC_CUES) + f", k as (select *, {plain_sql('text')} as t from cu), n as (select *, row_number() over (partition by media_id order by s, ord) - 1 as n from k where t <> '' and not contains(t, '-->'))"
_READ = f" select media_id as file_id, n as ord, cast(floor(s * 1000 + 0.5) as bigint) as s_ms, cast(floor(e * 1000 + 0.5) as bigint) as e_ms, t as text from n"


def _cues(spark, d):
    clean = ad.doc_cues(spark, d).withColumn("text", clean_plain(F.col("text")))
    return clean.where("text <> '' and not contains(text, '-->')")


def _out(df):
    return df.select("file_id", "ord", millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"), "text")


def _files(df, column, name):
    return df.select(F.col("media_id").alias("file_id"), F.concat(F.col("media_id").cast("string"), F.lit(name)).alias("filename"), F.col(column).alias("body"))


@query("sc13_read_srt", _CUES + _READ)
def sc13(spark, d):
    """Cues of documents written as SRT files and read again."""
    return _out(subtitles.read_srt(_files(export.to_srt(_cues(spark, d)), "srt", ".srt")))


@query("sc14_read_vtt", _CUES + _READ)
def sc14(spark, d):
    """Cues written as VTT files and read again."""
    found = subtitles.read_vtt(_files(export.to_vtt(_cues(spark, d)), "vtt", ".vtt"))
    return _out(found)


@query("sc17_read_vtt_panel", _CUES + _READ)
def sc17(spark, d):
    return _out(subtitles.read_vtt_panel(_files(export.to_vtt(_cues(spark, d)), "vtt", ".vtt")))


@query("sc18_read_vtt_overlay", _CUES + _READ)
def sc18(spark, d):
    return _out(subtitles.read_vtt_overlay(_files(export.to_vtt(_cues(spark, d)), "vtt", ".vtt")))


@query("sc15_read_ass", _CUES + _READ)
def sc15(spark, d):
    """Cues written as ASS files, with commas in their text, and read again."""
    from cuetide.functions.times import format_timestamp

    line = F.concat(F.lit("Dialogue: 0,"), format_timestamp(F.col("s")), F.lit(","), format_timestamp(F.col("e")), F.lit(",Default,,0,0,0,,"), F.col("text"))
    lines = _cues(spark, d).groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    found = subtitles.read_ass(_files(lines.withColumn("b", F.concat(F.lit(head), F.col("b"))), "b", ".ass"))
    return _out(found.withColumn("ord", F.col("ord") - 5))


@query("sc16_read_json", ad.with_views(ad.TURNS, ad.BILINGUAL) + ", r as (select media_id, s, e, text, 'source' as side, row_number() over (partition by media_id order by s) - 1 as ord from src union all select media_id, s, e, text, 'translated', row_number() over (partition by media_id order by s) - 1 from tra)" + f" select media_id as file_id, side, ord, cast(floor(s * 1000 + 0.5) as bigint) as s_ms, {plain_sql('text')} as text from r")
def sc16(spark, d):
    """Transcripts as JSON and read again."""
    sides = []
    for name, rows in zip(("source", "translated"), ad.bilingual(spark, d), strict=True):
        item = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "text", F.col("chunk").alias("chunkIndex"), F.col("seg").alias("segmentIndex"))
        sides.append(rows.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", item.alias("x")))), lambda v: v["x"]).alias(name)))
    files = sides[0].join(sides[1], "media_id", "full_outer").select("media_id", F.to_json(F.struct("source", "translated")).alias("b"))
    found = subtitles.read_json(_files(files, "b", ".json"))
    return found.select("file_id", "side", "ord", millis(F.col("s")).alias("s_ms"), "text")


@query("sc12_detect_format", "select doc_id as file_id, case doc_id % 6 when 0 then 'srt' when 1 then 'vtt' when 2 then 'ass' when 3 then 'json' when 4 then 'ssa' end as format from documents")
def sc12(spark, d):
    """By ending or content."""
    p = F.col("doc_id") % 6
    name = F.when(p == 0, "a.srt").when(p == 4, "b.SSA").otherwise("file")
    body = F.when(p == 1, "WEBVTT\n\n").when(p == 2, "[Events]\nDialogue: x").when(p == 3, '{"source": []}').otherwise("words")
    return ad.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), subtitles.detect_format(name, body).alias("format"))


@query("sc07_hls_segments", "select l_orderkey as media, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity::varchar) - 1 as idx, 'seg-' || l_partkey || '.ts' as uri, cast(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity::varchar rows unbounded preceding) as bigint) * 1000 as e_ms, l_linenumber > 2 as keyed from lineitem")
def sc07(spark, d):
    """Playlists made of orders: a segment per line, its length the quantity, a key from the third line on."""
    lines = F.concat(F.when(F.col("l_linenumber") > 2, '#EXT-X-KEY:METHOD=AES-128,URI="k.bin"\n').otherwise(""), F.lit("#EXTINF:"), F.col("l_quantity").cast("string"), F.lit(",\nseg-"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    bodies = ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", lines.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    found = manifests.hls_segments(bodies.select(F.col("l_orderkey").alias("url"), F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:60\n"), F.col("b")).alias("body")))
    return found.select(F.col("url").alias("media"), "idx", "uri", millis(F.col("e")).alias("e_ms"), F.col("key_uri").isNotNull().alias("keyed"))


@query("sc08_hls_byte_ranges", "with r as (select *, row_number() over w - 1 as idx, sum((l_linenumber % 3 = 1)::int) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as island from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) select l_orderkey as media, idx, cast(case when island > 0 then 500 else 0 end + coalesce(sum(l_partkey) over (partition by l_orderkey, island order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as start_byte, l_partkey as length from r")
def sc08(spark, d):
    """Byte ranges of one file, of which every third has an offset and the others follow; before the first stated one they
    start at zero."""
    rows = ad.table(spark, d, "lineitem")
    text = F.concat(F.lit("#EXTINF:4,\n#EXT-X-BYTERANGE:"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 1, "@500").otherwise(""), F.lit("\nall.ts"))
    bodies = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    found = manifests.hls_segments(bodies.select(F.col("l_orderkey").alias("url"), F.col("b").alias("body")))
    return found.select(F.col("url").alias("media"), "idx", F.col("offset").alias("start_byte"), "length")


@query("sc07_hls_variants", "select p_partkey as media, n as ord_no, case when n = 0 then 'a.m3u8' else 'v' || n || '.m3u8' end as uri, cast(case when n = 0 then 0 else p_size * 1000 * n end as int) as bandwidth, n = 0 or (n = 2 and p_size % 2 = 0) as audio_only from part, range(3) r(n)")
def sc07v(spark, d):
    """Master playlists made of parts: a rendition of sound and two streams."""
    size = F.col("p_size")
    body = F.concat(F.lit('#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="x, y",URI="a.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH='), (size * 1000).cast("string"), F.lit(',RESOLUTION=640x360,CODECS="avc1.4d,mp4a.40.2",AUDIO="a"\nv1.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH='), (size * 2000).cast("string"), F.when(size % 2 == 0, ',CODECS="mp4a.40.2"').otherwise(""), F.lit("\n\nv2.m3u8\n"))
    found = manifests.hls_variants(ad.table(spark, d, "part").select(F.col("p_partkey").alias("url"), body.alias("body")))
    from pyspark.sql import Window

    n = (F.row_number().over(Window.partitionBy("url").orderBy("ord")) - 1).cast("long")
    return found.select(F.col("url").alias("media"), n.alias("ord_no"), "uri", F.col("bandwidth").cast("int").alias("bandwidth"), "audio_only")


@query("iv16_dash_timeline", "select p_partkey as media, k as place, 'r1/' || lpad((5 + k)::varchar, 4, '0') || '.m4s' as uri, k * 5000 as s_ms, (k + 1) * 5000 as e_ms from part, range(60) r(k) where k <= p_size")
def iv16(spark, d):
    """A timeline with one run of p_size repeats, numbered from 5."""
    body = F.concat(F.lit('<MPD mediaPresentationDuration="PT10M"><Period><AdaptationSet mimeType="audio/mp4"><SegmentTemplate timescale="1000" startNumber="5" initialization="i.mp4" media="$RepresentationID$/$Number%04d$.m4s"><SegmentTimeline><S t="0" d="5000" r="'), F.col("p_size").cast("string"), F.lit('"/></SegmentTimeline></SegmentTemplate><Representation id="r1" bandwidth="64000"/></AdaptationSet></Period></MPD>'))
    reps = manifests.dash_representations(ad.table(spark, d, "part").select(F.col("p_partkey").alias("url"), body.alias("body")))
    found = manifests.dash_segments(reps)
    return found.select(F.col("url").alias("media"), (F.col("number") - 5).alias("place"), "uri", millis(F.col("s")).cast("long").alias("s_ms"), millis(F.col("e")).alias("e_ms"))


@query("sc10_dash_representations", "select p_partkey as media, n as rep, case n when 0 then 'lo' else 'hi' end as id, cast(p_size * (n + 1) * 100 as bigint) as bandwidth, 'audio/mp4' as mime, 'http://c/' as base from part, range(2) r(n)")
def sc10(spark, d):
    size = F.col("p_size")
    body = F.concat(F.lit('<MPD mediaPresentationDuration="PT1M30S"><Period><AdaptationSet mimeType="audio/mp4"><BaseURL>http://c/</BaseURL><SegmentTemplate duration="4" media="$Number$.m4s"/><Representation id="lo" bandwidth="'), (size * 100).cast("string"), F.lit('"/><Representation id="hi" bandwidth="'), (size * 200).cast("string"), F.lit('"></Representation></AdaptationSet></Period></MPD>'))
    found = manifests.dash_representations(ad.table(spark, d, "part").select(F.col("p_partkey").alias("url"), body.alias("body")))
    return found.select(F.col("url").alias("media"), F.col("rep_no").cast("long").alias("rep"), "id", "bandwidth", "mime", "base")


@query("sc23_silence_log", """with n as (select user_id as media_id, count(*) as n from events where event_type = 'error' group by 1), k as (select *, unnest(range(n + 1)) as k from n)
select media_id, case when k = 0 then 0 else k * 30000 - 15400 end as s_ms, case when k = n then k * 30000 + 400 else k * 30000 + 10400 end as e_ms from k""")
def sc23(spark, d):
    """Logs with silences apart: one more interval of speech than silences, padded."""
    line = F.concat(F.lit("[x] silence_start: "), (F.col("n") * 30 + 10).cast("string"), F.lit("\n[x] silence_end: "), (F.col("n") * 30 + 15).cast("string"), F.lit(" | silence_duration: 5"))
    from pyspark.sql import Window

    numbered = ad.table(spark, d, "events").where("event_type = 'error'").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    logs = numbered.groupBy(F.col("user_id").alias("media_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"), (F.count(F.lit(1)) * F.lit(30.0)).alias("duration"))
    return speech.speech_from_silence_log(logs).select("media_id", millis(F.col("s")).alias("s_ms"), millis(F.col("e")).alias("e_ms"))


@query("sc19_recognition_payloads", "select user_id as chunk_id, row_number() over (partition by user_id order by event_id) - 1 as ord, cast(floor(value * 1000 + 0.5) as bigint) as s_ms, event_type as text, 1 as words from events where value >= 0")
def sc19(spark, d):
    """Payloads with segments and words, read again."""
    word = F.struct(F.lit("w").alias("word"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"))
    item = F.struct(F.col("event_type").alias("text"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.array(word).alias("words"))
    lists = ad.table(spark, d, "events").where("value >= 0").groupBy(F.col("user_id").alias("chunk_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda v: v["x"]).alias("segments"))
    found = speech.read_payloads(lists.select("chunk_id", F.to_json(F.struct("segments")).alias("payload")))
    return found.select("chunk_id", "ord", millis(F.col("s")).alias("s_ms"), "text", F.size("words").alias("words"))
