"""Players' JSON, binary media heads and service payloads as tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.functions.text import clean_cue
from cuetide.functions.times import round_seconds
from cuetide.functions.urls import is_placeholder

_TRACK = "struct<baseUrl:string,base_url:string,backupUrl:array<string>,backup_url:array<string>,codecs:string,bandwidth:bigint,width:int,height:int>"
_DASH = f"struct<dash:struct<duration:double,audio:array<{_TRACK}>,video:array<{_TRACK}>>>"
_NONE = "array<string>"


def playinfo_assets(df: DataFrame) -> DataFrame:
    """df: page_id, payload. (page_id, role, place, url, bitrate, duration): an asset per different URL of a track, its
    backups included; sound first. The tracks are at the top, or under `data` or `result`."""
    tops = [F.from_json("payload", _DASH), *[F.from_json(F.get_json_object("payload", f"$.{k}"), _DASH) for k in ("data", "result")]]
    dash = F.coalesce(*[t["dash"] for t in tops])
    parsed = df.select("page_id", dash.alias("d"))
    empty = F.array().cast(_NONE)
    found = None
    for role in ("audio", "video"):
        rows = parsed.select("page_id", F.lit(role).alias("role"), F.col("d.duration").alias("duration"), F.posexplode(f"d.{role}").alias("track", "x"))
        urls = F.array_distinct(F.filter(F.concat(F.array("x.baseUrl", "x.base_url"), F.coalesce("x.backupUrl", empty), F.coalesce("x.backup_url", empty)), lambda u: u.isNotNull() & (u != "")))
        own = rows.select("page_id", "role", "duration", F.col("x.bandwidth").alias("bitrate"), "track", F.posexplode(urls).alias("place", "url"))
        found = own if found is None else found.unionByName(own)
    return found.select("page_id", "role", "track", "place", "url", "bitrate", "duration")


_FORMAT = "array<struct<url:string,signatureCipher:string,cipher:string,mimeType:string,bitrate:bigint,approxDurationMs:string,itag:int>>"


def player_formats(df: DataFrame) -> DataFrame:
    """df: page_id, payload. (page_id, url, role, container, codecs, bitrate, duration, needs_deciphering): formats and
    adaptive formats, a ciphered URL taken from its parameters; placeholders are left out."""
    data = F.from_json(F.get_json_object("payload", "$.streamingData"), f"struct<formats:{_FORMAT},adaptiveFormats:{_FORMAT}>")
    empty = F.array().cast(_FORMAT)
    rows = df.select("page_id", data.alias("d")).select("page_id", F.explode(F.concat(F.coalesce("d.formats", empty), F.coalesce("d.adaptiveFormats", empty))).alias("x"))
    hidden = F.coalesce("x.signatureCipher", "x.cipher")
    deciphered = F.try_url_decode(F.regexp_extract(hidden, "(?:^|&)url=([^&]*)", 1))
    url = F.coalesce("x.url", F.nullif(deciphered, F.lit("")))
    mime = F.coalesce("x.mimeType", F.lit(""))
    role = F.when(mime.startswith("audio/"), "audio").when(mime.startswith("video/"), "video").otherwise("unknown")
    found = rows.select("page_id", url.alias("url"), role.alias("role"), F.when(F.contains(mime, F.lit("webm")), "webm").otherwise("mp4").alias("container"), F.regexp_extract(mime, 'codecs="([^"]+)"', 1).alias("codecs"), F.col("x.bitrate").alias("bitrate"), (F.col("x.approxDurationMs").try_cast("double") / 1000).alias("duration"), (F.col("x.url").isNull() & hidden.isNotNull()).alias("needs_deciphering"))
    return found.where(F.col("url").isNotNull() & ~is_placeholder(F.col("url")))


_VARIANT = "struct<duration_millis:double,variants:array<struct<url:string,content_type:string,bitrate:bigint>>>"
_SIZES = "struct<large:struct<w:int,h:int>,medium:struct<w:int,h:int>,small:struct<w:int,h:int>,thumb:struct<w:int,h:int>>"


def post_videos(df: DataFrame) -> DataFrame:
    """df: post_id, payload. A row per video variant of a post's media: duration, and the largest size that is given."""
    media = F.from_json(F.get_json_object("payload", "$.media"), f"array<struct<video_info:{_VARIANT},sizes:{_SIZES}>>")
    rows = df.select("post_id", F.explode(media).alias("m")).select("post_id", "m", F.explode("m.video_info.variants").alias("v"))
    size = F.coalesce(*[F.when((F.col(f"m.sizes.{n}.w") > 0) & (F.col(f"m.sizes.{n}.h") > 0), F.col(f"m.sizes.{n}")) for n in ("large", "medium", "small", "thumb")])
    return rows.select("post_id", F.col("v.url").alias("url"), F.col("v.content_type").alias("content_type"), F.col("v.bitrate").alias("bitrate"), (F.col("m.video_info.duration_millis") / 1000).alias("duration"), size["w"].alias("width"), size["h"].alias("height"))


_SENTENCE = "array<struct<begin_time:double,start_time:double,start:double,end_time:double,end:double,text:string,sentence:string,speaker_id:int>>"


def seconds_or_millis(c: Column) -> Column:
    """Values of a thousand and more are milliseconds."""
    return F.when(F.abs(c) >= 1000, c / 1000).otherwise(c)


def sentence_payloads(df: DataFrame, slack: float = 1.5) -> DataFrame:
    """df: chunk_id, payload, start, core_s, core_e. (chunk_id, s, e, text, speaker): sentences of all transcripts, else of
    the top, moved to the chunk's start, those about the core."""
    nested = F.flatten(F.transform(F.from_json(F.get_json_object("payload", "$.transcripts"), f"array<struct<sentences:{_SENTENCE}>>"), lambda t: F.coalesce(t["sentences"], F.array().cast(_SENTENCE))))
    top = F.from_json(F.get_json_object("payload", "$.sentences"), _SENTENCE)
    rows = df.select("chunk_id", "start", "core_s", "core_e", F.explode(F.when(F.size(nested) > 0, nested).otherwise(top)).alias("x"))
    at = lambda *names: round_seconds(F.col("start") + seconds_or_millis(F.coalesce(*[F.col(f"x.{n}") for n in names])))
    found = rows.select("chunk_id", "core_s", "core_e", at("begin_time", "start_time", "start").alias("s"), at("end_time", "end").alias("e"), clean_cue(F.coalesce(F.nullif("x.text", F.lit("")), F.col("x.sentence"))).alias("text"), F.col("x.speaker_id").alias("speaker"))
    return found.where((F.col("e") > F.col("core_s") - slack) & (F.col("s") < F.col("core_e") + slack) & (F.col("e") > F.col("s")) & (F.col("text") != "")).drop("core_s", "core_e")


_RANGE = "array<struct<start_ms:double,end_ms:double,start_time:double,end_time:double,start:double,end:double>>"


def activity_payloads(df: DataFrame, long_chunk: float = 120.0, max_value: float = 1000.0, min_span: float = 45.0) -> DataFrame:
    """df: chunk_id, payload, start, end. (chunk_id, intervals): speech intervals of a detector, clamped to the chunk and
    sorted; null where the payload has no list, which is not the same as an empty one. Bare whole numbers are milliseconds
    if they span more than seconds could, or lie beyond the chunk."""
    lists = [F.from_json("payload", _RANGE), *[F.from_json(F.get_json_object("payload", f"$.{k}"), _RANGE) for k in ("speech_segments", "segments", "timestamps")]]
    is_list = F.trim("payload").startswith("[")
    items = F.coalesce(F.when(is_list, lists[0]), *lists[1:])
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))

    def span(x: Column) -> Column:
        a, b = x["start"], x["end"]
        whole = (a == F.floor(a)) & (b == F.floor(b))
        most = F.greatest(F.abs(a), F.abs(b))
        plain = (length >= long_chunk) & (most < max_value) & (most <= length + 1) & (b - a > min_span)
        bare = F.when(whole & ~plain & ((b - a > 45) | ((length > 0) & (most > length + 1))), F.lit(1000.0)).otherwise(1.0)
        # The first kind of bounds of which there is one; a bound that lacks its other is no interval.
        kinds = [(x["start_ms"] / 1000, x["end_ms"] / 1000), (x["start_time"], x["end_time"])]
        some = [low.isNotNull() | high.isNotNull() for low, high in kinds]
        low, high = (F.when(some[0], kinds[0][i]).when(some[1], kinds[1][i]).otherwise(c / bare) for i, c in enumerate((a, b)))
        clamped = F.struct(F.greatest(F.col("start"), F.col("start") + low).alias("start"), F.least(F.col("end"), F.col("start") + high).alias("end"))
        return F.when(high > low, clamped)

    found = F.array_sort(F.filter(F.transform(items, span), lambda x: x["end"] > x["start"]))
    return df.select("chunk_id", found.alias("intervals"))


def mp4_role(content: Column) -> Column:
    """audio or video for the head of an MP4 with one kind of track, else null; by its boxes, so in Python."""

    def boxes(data: bytes, at: int, end: int, kind: bytes):
        while at + 8 <= end:
            size, name = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                return
            if name == kind:
                yield at + head, at + size
            at += size

    def role(data: bytes | None) -> str | None:
        if data is None or len(data) < 16:
            return None
        kinds = {data[d + 8 : d + 12] for a, b in boxes(data, 0, len(data), b"moov") for c, e in boxes(data, a, b, b"trak") for f, g in boxes(data, c, e, b"mdia") for d, _ in boxes(data, f, g, b"hdlr")}
        return "audio" if b"soun" in kinds and b"vide" not in kinds else "video" if b"vide" in kinds and b"soun" not in kinds else None

    @F.pandas_udf("string")
    def read(batch: pd.Series) -> pd.Series:
        return batch.map(role)

    return read(content)


def audio_head(content: Column) -> Column:
    """mp3, wav, text (an error in place of media) or null, by a payload's first bytes."""
    hexed = F.upper(F.hex(F.substring(content, 1, 16)))
    first = F.regexp_extract(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), r"^\s*(.)", 1)
    return F.when(hexed.startswith("52494646") & F.substring(hexed, 17, 8).eqNullSafe("57415645"), "wav").when(hexed.startswith("494433") | hexed.rlike("^FF[EF]"), "mp3").when(first.isin("<", "{", "["), "text")


def page_duration(html: Column) -> Column:
    """Seconds: of the first duration meta tag, whatever the order of its attributes, else of a time tag; where that is no
    duration, the first one that JSON-LD scripts state."""
    from cuetide.functions.times import duration_value

    content = r"""(?i)(?<![\w-])content\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1), lambda t: t.rlike(r"""(?i)(?<![\w-])(?:property|itemprop|name)\s*=\s*["']?(?:video:duration|og:video:duration|duration)["'\s/>]"""))
    said = F.filter(F.transform(tags, lambda t: F.concat(*[F.regexp_extract(t, content, i) for i in (1, 2, 3)])), lambda v: v != "")
    timed = F.nullif(F.regexp_extract(html, r"""(?is)<time\b[^>]*?(?<![\w-])datetime\s*=\s*["']([^"']+)""", 1), F.lit(""))
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1)
    stated = F.flatten(F.transform(scripts, lambda x: F.regexp_extract_all(x, F.lit(r"""(?i)"(?:duration|lengthSeconds|durationSeconds)"\s*:\s*"?([^",}\]]+)"""), 1)))
    positive = lambda c: F.when(duration_value(c) > 0, duration_value(c))
    linked = F.get(F.filter(F.transform(stated, lambda v: positive(F.trim(v))), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(positive(F.coalesce(F.get(said, F.lit(0)), timed)), linked)
