"""Subtitle files from cues. One text per media: its cues meet in one group, which is the file that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.functions.times import format_timestamp


def to_srt(df: DataFrame, lines: Column | None = None, note: Column | None = None) -> DataFrame:
    """df: media_id, s, e, text, ord. (media_id, srt), cues numbered from 1; nothing for a media without text."""
    text = F.col("text") if lines is None else lines
    kept = df.withColumn("_t", text).where((F.col("_t") != "") & F.col("s").isNotNull() & F.col("e").isNotNull())
    times = F.concat_ws(" --> ", format_timestamp(F.col("s"), ","), format_timestamp(F.col("e"), ","))
    blocks = kept.select("media_id", F.struct("s", "ord", F.concat(times, F.lit("\n"), F.col("_t")).alias("_b")).alias("_x"))
    # A cue's number is its place in the sorted list, so one shuffle and one sort do.
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["_b"])), "\n\n")
    head = F.lit("") if note is None else F.concat(note, F.lit("\n\n"))
    return blocks.groupBy("media_id").agg(F.concat(head, body, F.lit("\n")).alias("srt"))


def to_vtt(df: DataFrame, lines: Column | None = None) -> DataFrame:
    """(media_id, vtt), in order of start."""
    text = F.col("text") if lines is None else lines
    kept = df.withColumn("_t", text).where((F.col("_t") != "") & F.col("s").isNotNull() & F.col("e").isNotNull())
    times = F.concat_ws(" --> ", format_timestamp(F.col("s")), format_timestamp(F.col("e")))
    blocks = kept.select("media_id", F.struct("s", "ord", F.concat(times, F.lit("\n"), F.col("_t"), F.lit("\n")).alias("_b")).alias("_x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_b"]), "\n")
    return blocks.groupBy("media_id").agg(F.concat(F.lit("WEBVTT\n\n"), body).alias("vtt"))


def to_playlist(df: DataFrame, version: int = 7) -> DataFrame:
    """df: media_id, ord, seconds, name, map_name, key_line, discontinuity (the last three null or false where there is
    none). (media_id, playlist): local files as a playlist, map and key stated where they change."""
    changed = lambda now, before, i: F.when(i == 0, now.isNotNull()).otherwise(~now.eqNullSafe(before))
    fields = F.struct("ord", "seconds", "name", F.col("map_name").alias("map"), F.col("key_line").alias("key"), "discontinuity")
    lists = df.groupBy("media_id").agg(F.array_sort(F.collect_list(fields)).alias("x"))
    line = lambda x, before, i: F.concat(
        F.when(F.coalesce(x["discontinuity"], F.lit(False)), "#EXT-X-DISCONTINUITY\n").otherwise(""),
        F.when(changed(x["map"], before["map"], i) & x["map"].isNotNull(), F.concat(F.lit('#EXT-X-MAP:URI="'), x["map"], F.lit('"\n'))).otherwise(""),
        F.when(changed(x["key"], before["key"], i), F.concat(F.lit("#EXT-X-KEY:"), F.coalesce(x["key"], F.lit("METHOD=NONE")), F.lit("\n"))).otherwise(""),
        F.lit("#EXTINF:"), F.greatest(F.lit(0.0), F.coalesce(x["seconds"], F.lit(0.0))).cast("decimal(18,6)").cast("string"), F.lit(",\n"), x["name"],
    )
    body = F.array_join(F.transform("x", lambda x, i: line(x, F.get(F.col("x"), i - 1), i)), "\n")
    target = F.greatest(F.lit(1), F.ceil(F.array_max(F.transform("x", lambda x: F.coalesce(x["seconds"], F.lit(0.0))))))
    head = F.concat(F.lit(f"#EXTM3U\n#EXT-X-VERSION:{version}\n#EXT-X-TARGETDURATION:"), target.cast("string"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:0\n"))
    return lists.select("media_id", F.concat(head, body, F.lit("\n#EXT-X-ENDLIST\n")).alias("playlist"))


def note_block(source_page: Column, exported_by: Column) -> Column:
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.lit("NOTE"), line("Source page", source_page), line("Exported by", exported_by))


def transcript_json(df: DataFrame) -> DataFrame:
    """(media_id, transcript): source and translated arrays of start, end and text as JSON."""
    one = lambda c: F.struct("s", F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col(c).alias("text")).alias("x"))
    lists = df.groupBy("media_id").agg(*[F.transform(F.array_sort(F.collect_list(one(c))), lambda v: v["x"]).alias(n) for n, c in (("source", "source_text"), ("translated", "text"))])
    return lists.select("media_id", F.to_json(F.struct("source", "translated")).alias("transcript"))
