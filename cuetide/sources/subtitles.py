"""Subtitle files as segments. A file is one row (file_id, filename, body), as spark.read.text(wholetext=True) gives it.

Every reader returns (file_id, ord, s, e, text), ord being the place of the block or line in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.text import clean_import, clean_plain
from cuetide.functions.times import parse_timestamp

_ARROW = "-->"


def normal_lines(body: Column) -> Column:
    """Without a byte-order mark, with line feeds only."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\x{feff}", ""), "\r\n?", "\n")


def detect_format(filename: Column, body: Column) -> Column:
    """json, vtt, srt, ass, ssa, or null: by the name's ending, then by the content."""
    name, text = F.lower(F.coalesce(filename, F.lit(""))), F.trim(normal_lines(body))
    srt = text.rlike(r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}\s*-->\s*[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}")
    ass = text.rlike(r"(?i)\[Events\]") & text.rlike(r"(?im)^Dialogue\s*:")
    found = F.when(name.endswith(".json") | text.startswith("{"), "json").when(name.endswith(".vtt") | text.rlike(r"(?i)^WEBVTT\b"), "vtt")
    found = found.when(name.endswith(".srt") | srt, "srt").when(name.endswith(".ssa"), "ssa").when(name.endswith(".ass") | ass, "ass")
    return F.when(text == "", None).otherwise(found)


def read_blocks(df: DataFrame, body: Column, clean=clean_import, joint: str = " ") -> DataFrame:
    """SRT and VTT blocks: the first line with an arrow has the times, those after it the text."""
    blocks = df.select("file_id", F.posexplode(F.split(normal_lines(body), r"\n{2,}")).alias("ord", "block"))
    blocks = blocks.where(~F.trim("block").rlike(r"(?i)^(?:NOTE|STYLE|REGION)(?:\s|$)"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    placed = blocks.select("file_id", "ord", lines.alias("lines"))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit(_ARROW))), True)
    timed = placed.withColumn("at", at).where("at > 0").withColumn("timing", F.get("lines", F.col("at").cast("int") - 1))
    times = F.split("timing", _ARROW)
    end = F.element_at(F.split(F.trim(F.element_at(times, 2)), r"\s+"), 1)
    text = clean(F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines")), joint))
    found = timed.select("file_id", F.col("ord").cast("long").alias("ord"), parse_timestamp(F.trim(F.element_at(times, 1))).alias("s"), parse_timestamp(end).alias("e"), text.alias("text"))
    return found.where("s is not null and e is not null and text <> ''")


def read_srt(df: DataFrame) -> DataFrame:
    return read_blocks(df, F.col("body")).where("e >= s")


def vtt_body(body: Column) -> Column:
    headless = F.regexp_replace(normal_lines(body), r"(?i)^WEBVTT[^\n]*(?:\n|$)", "")
    return F.regexp_replace(headless, r"(?i)^(?:Kind|Language):[^\n]*\n", "")


def read_vtt(df: DataFrame) -> DataFrame:
    """Imported VTT: as SRT, without the header."""
    return read_blocks(df, vtt_body(F.col("body"))).where("e >= s")


def read_vtt_panel(df: DataFrame) -> DataFrame:
    """VTT as the panel reads it: no entities decoded, an end before the start allowed."""
    return read_blocks(df, vtt_body(F.col("body")), clean=clean_plain)


def read_vtt_overlay(df: DataFrame) -> DataFrame:
    """VTT as the overlay reads it: line breaks within a cue stay."""
    keep_breaks = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    return read_blocks(df, vtt_body(F.col("body")), clean=keep_breaks, joint="\n").where("e > s")


def read_ass(df: DataFrame) -> DataFrame:
    """ASS and SSA: dialogue lines of the Events section, by the columns of the Format line before them; the last column,
    the text, keeps its commas."""
    lines = df.select("file_id", F.posexplode(F.split(normal_lines(F.col("body")), "\n")).alias("ord", "line"))
    lines = lines.select("file_id", "ord", F.trim("line").alias("line")).where("line <> '' and not startswith(line, ';')")
    before = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("line").rlike(r"^\[.+\]$"), F.lower("line")), ignorenulls=True).over(before)
    given = F.last(F.when(F.col("line").rlike(r"(?i)^format\s*:") & (F.col("section") == "[events]"), F.lower(F.regexp_replace("line", r"(?i)^format\s*:", ""))), ignorenulls=True).over(before)
    events = lines.withColumn("section", section).withColumn("given", given).where((F.col("section") == "[events]") & F.col("line").rlike(r"(?i)^dialogue\s*:"))
    names = F.transform(F.split(F.coalesce("given", F.lit("")), ","), lambda x: F.trim(x))
    count = F.greatest(F.size(names), F.lit(10))
    body = F.trim(F.regexp_replace("line", r"(?i)^dialogue\s*:", ""))
    split = events.withColumns({"names": names, "count": count}).withColumn("fields", F.transform(F.split(body, ",", F.col("count")), lambda x: F.trim(x)))
    shift = F.when(F.size("fields") >= 10, 0).otherwise(-1)
    at = lambda name, default: F.when(F.array_contains("names", name), F.array_position("names", name).cast("int")).otherwise(default)
    field = lambda place: F.try_element_at("fields", place)
    text = clean_import(field(at("text", F.size("fields"))))
    found = split.select("file_id", F.col("ord").cast("long").alias("ord"), parse_timestamp(field(at("start", F.lit(2) + shift))).alias("s"), parse_timestamp(field(at("end", F.lit(3) + shift))).alias("e"), text.alias("text"))
    return found.where("s is not null and e is not null and text <> '' and e >= s")


TRANSCRIPT = "source array<struct<start:double,end:double,text:string,chunkIndex:bigint,segmentIndex:bigint>>, translated array<struct<start:double,end:double,text:string,chunkIndex:bigint,segmentIndex:bigint>>"


def read_json(df: DataFrame) -> DataFrame:
    """Transcripts: (file_id, side, ord, s, e, text, chunk, seg), from `transcript` or the top level."""
    whole = F.from_json("body", TRANSCRIPT)
    inner = F.from_json(F.get_json_object("body", "$.transcript"), TRANSCRIPT)
    parsed = df.select("file_id", F.coalesce(inner, whole).alias("t"))
    sides = [parsed.select("file_id", F.lit(side).alias("side"), F.posexplode(f"t.{side}").alias("ord", "x")) for side in ("source", "translated")]
    rows = sides[0].unionByName(sides[1])
    both = F.col("x.chunkIndex").isNotNull() & F.col("x.segmentIndex").isNotNull()
    found = rows.select("file_id", "side", F.col("ord").cast("long").alias("ord"), F.col("x.start").alias("s"), F.col("x.end").alias("e"), clean_import(F.col("x.text")).alias("text"), F.when(both, F.col("x.chunkIndex")).alias("chunk"), F.when(both, F.col("x.segmentIndex")).alias("seg"))
    return found.where("s is not null and e >= s and text <> ''")


def read_any(df: DataFrame) -> DataFrame:
    """Files of any kind, with their format; files in JSON give their translation, or else their source."""
    known = df.withColumn("format", detect_format(F.col("filename"), F.col("body")))
    parts = [("srt", read_srt), ("vtt", read_vtt), ("ass", read_ass), ("ssa", read_ass)]
    found = None
    for name, read in parts:
        own = read(known.where(F.col("format") == name)).withColumn("format", F.lit(name))
        found = own if found is None else found.unionByName(own)
    sides = read_json(known.where("format = 'json'"))
    best = F.max("side").over(Window.partitionBy("file_id"))
    own = sides.withColumn("_best", best).where("side = _best").select("file_id", "ord", "s", "e", "text", F.lit("json").alias("format"))
    return found.unionByName(own)
