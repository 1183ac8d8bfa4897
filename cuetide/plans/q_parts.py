"""Queries of operators that others contain, each on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetide.functions.times import iso_duration, millis
from cuetide.operators import guards, intervals
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_media import _WORDS, _worded
from cuetide.sources import manifests, speech

_MS = lambda c: f"cast(floor(({c}) * 1000 + 0.5) as bigint)"


def _guard(spark, d, column):
    return guards.word_stats(_worded(spark, d)).select("media_id", "ord", column.alias("found"))


@query("f09_suspicious_timing", ad.with_views(ad.TURNS, _WORDS) + "select media_id, ord, suspicious as found from g2")
def f09(spark, d):
    return _guard(spark, d, guards.is_suspicious_timing())


@query("f10_word_anomaly", ad.with_views(ad.TURNS, _WORDS) + "select media_id, ord, anomaly as found from g2")
def f10(spark, d):
    return _guard(spark, d, guards.is_word_anomaly())


@query("f11_unlike_speech", ad.with_views(ad.EVENT_SEGMENTS) + "select media_id, ord, compression >= 4 and no_speech >= 0.35e0 as found from ev")
def f11(spark, d):
    """The part that looks at quality alone."""
    return ad.event_segments(spark, d).select("media_id", "ord", guards.is_vad_hallucination().alias("found"))


@query("f12_weak_evidence", ad.with_views(ad.TURNS, _WORDS) + "select media_id, ord, n_words > 0 and chars >= 6 and (coverage or (weak >= 1 and chars >= 10 and cover < 0.7) or weak >= 2 or (weak >= 1 and (d >= 3 or longest >= 2.5 or n_words <= 2))) as found from g2")
def f12(spark, d):
    return _guard(spark, d, guards.weak_evidence())


@query("j12_rows_in_spans", ad.with_views(ad.EVENT_SEGMENTS, ad.SPEECH, ad.VIEWS) + "select media_id, ord from sg where exists (select 1 from sp where sp.media_id = sg.media_id and sg.s < sp.e + 0.2e0 and sp.s - 0.2e0 < sg.e)")
def j12(spark, d):
    """Rows that touch a span, widened a little: each once."""
    spans = ad.speech(spark, d).select("media_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    return intervals.overlap_join(ad.views(spark, d), spans, slack=0.2, how="left_semi").select("media_id", "ord")


@query("sc20_word_items", "select event_id as chunk_id, i as pos, case i when 0 then 'one' else 'two' end as text, case when i = 0 then 5e-1 when k % 2 = 0 then k / 100e0 end as probability from (select event_id, cast(json_extract_string(props, '$.k') as int) as k, unnest([0, 1]) as i from events)")
def sc20(spark, d):
    """Words under two of their names, one without a probability, one without length and one without text left out."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(F.lit('{"words": [{"word": "one", "start": 0, "end": 1, "prob": 0.5}, {"text": "none", "start": 2, "end": 2}, {"token": "two", "start_time": 2, "end_time": 3'), F.when(k % 2 == 0, F.concat(F.lit(', "probability": '), (k / 100.0).cast("string"))).otherwise(""), F.lit('}, {"word": " ", "start": 3, "end": 4}]}'))
    found = speech.top_words(ad.table(spark, d, "events").select(F.col("event_id").alias("chunk_id"), body.alias("payload")))
    rows = found.select("chunk_id", F.posexplode("top").alias("pos", "w"))
    return rows.select("chunk_id", "pos", "w.text", "w.probability")


@query("sc09_manifest_summaries", "select l_orderkey as media, count(*) as segments, cast(sum(l_quantity) * 1000 as bigint) as total_ms from lineitem group by 1")
def sc09(spark, d):
    """Playlists as they are found: how many segments, and how long together."""
    line = F.concat(F.lit("#EXTINF:"), F.col("l_quantity").cast("string"), F.lit(",\nseg-"), F.col("l_partkey").cast("string"), F.lit(".ts"))
    bodies = ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    found = manifests.summaries(bodies.select(F.col("l_orderkey").alias("url"), F.concat(F.lit("#EXTM3U\n"), F.col("b")).alias("body")))
    return found.select(F.col("url").alias("media"), "segments", millis(F.col("total")).alias("total_ms"))


@query("sc11_dash_durations", f"select p_partkey as media, {_MS('p_size * 60 + 1.5e0')} as total_ms from part")
def sc11(spark, d):
    text = F.concat(F.lit('<?xml version="1.0"?><MPD type="static" mediaPresentationDuration="PT'), F.col("p_size").cast("string"), F.lit('M1.5S" profiles="x"></MPD>'))
    return ad.table(spark, d, "part").select(F.col("p_partkey").alias("media"), millis(iso_duration(manifests.dash_duration(text))).alias("total_ms"))


@query("iv17_byte_ranges_by_file", """with r as (select *, row_number() over w - 1 as idx, l_linenumber % 2 as file from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))
select l_orderkey as media, idx, 'f' || file || '.ts' as uri, cast(coalesce(sum(l_partkey) over (partition by l_orderkey, file order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as start_byte from r""")
def iv17(spark, d):
    """Two files in turn: an offset that is not given follows the last one of its own file."""
    text = F.concat(F.lit("#EXTINF:4,\n#EXT-X-BYTERANGE:"), F.col("l_partkey").cast("string"), F.lit("\nf"), (F.col("l_linenumber") % 2).cast("string"), F.lit(".ts"))
    bodies = ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    found = manifests.hls_segments(bodies.select(F.col("l_orderkey").alias("url"), F.col("b").alias("body")))
    return found.select(F.col("url").alias("media"), "idx", "uri", F.col("offset").alias("start_byte"))
