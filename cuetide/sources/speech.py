"""Output of speech recognition and silence detection as segments and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.text import clean_cue
from cuetide.operators.intervals import pad

_WORD = "array<struct<word:string,text:string,token:string,start:double,start_time:double,end:double,end_time:double,probability:double,prob:double>>"
_ITEM = f"array<struct<text:string,transcript:string,start:double,start_time:double,end:double,end_time:double,compression_ratio:double,no_speech_prob:double,avg_logprob:double,words:{_WORD},word_timestamps:{_WORD},tokens:{_WORD}>>"
_SCHEMA = "struct<" + ",".join(f"{n}:{_ITEM}" for n in ("segments", "results", "chunks")) + "," + ",".join(f"{n}:{_WORD}" for n in ("words", "word_timestamps")) + ",text:string>"


def _first_text(x: Column, names: list[str]) -> Column:
    return clean_cue(F.coalesce(*[F.nullif(x[n], F.lit("")) for n in names]))


def words_of(items: Column) -> Column:
    """Words of a positive length, with start, end, text and a probability that may be null."""
    named = F.transform(items, lambda w: F.struct(F.coalesce(w["start"], w["start_time"]).alias("start"), F.coalesce(w["end"], w["end_time"]).alias("end"), _first_text(w, ["word", "text", "token"]).alias("text"), F.coalesce(w["probability"], w["prob"]).alias("probability")))
    return F.filter(named, lambda w: (w["text"] != "") & (w["end"] > w["start"]))


def read_payloads(df: DataFrame) -> DataFrame:
    """df: chunk_id, payload (JSON). (chunk_id, ord, s, e, text, words, compression, no_speech, logprob): the first of the
    lists segments, results and chunks, at the top or under `result`; bounds narrowed to the words if those fit."""
    top = F.from_json("payload", _SCHEMA)
    inner = F.from_json(F.get_json_object("payload", "$.result"), _SCHEMA)
    lists = df.select("chunk_id", top.alias("t"), inner.alias("r")).select("chunk_id", F.coalesce(*[F.col(f"{p}.{n}") for p in "tr" for n in ("segments", "results", "chunks")]).alias("items"))
    rows = lists.select("chunk_id", F.posexplode("items").alias("ord", "x"))
    plain = rows.select("chunk_id", F.col("ord").cast("long").alias("ord"), F.coalesce("x.start", "x.start_time").alias("s"), F.coalesce("x.end", "x.end_time").alias("e"), _first_text(F.col("x"), ["text", "transcript"]).alias("text"), words_of(F.coalesce("x.words", "x.word_timestamps", "x.tokens")).alias("words"), F.col("x.compression_ratio").alias("compression"), F.col("x.no_speech_prob").alias("no_speech"), F.col("x.avg_logprob").alias("logprob"))
    plain = plain.where("text <> '' and e > s")
    low, high = F.array_min(F.transform("words", lambda w: w["start"])), F.array_max(F.transform("words", lambda w: w["end"]))
    near = (low >= F.col("s") - 0.5) & (low <= F.col("e") + 0.5) & (high >= F.col("s") - 0.5) & (high <= F.col("e") + 0.5) & (high > low)
    fits = F.coalesce(near, F.lit(False))
    return plain.withColumns({"s": F.when(fits, low).otherwise(F.col("s")), "e": F.when(fits, high).otherwise(F.col("e"))})


def _parts(df: DataFrame) -> DataFrame:
    """The payload's top, and what it has under `result`."""
    return df.select("chunk_id", F.from_json("payload", _SCHEMA).alias("t"), F.from_json(F.get_json_object("payload", "$.result"), _SCHEMA).alias("r"))


def top_words(df: DataFrame) -> DataFrame:
    """(chunk_id, top): the words that a payload gives beside its segments."""
    return _parts(df).select("chunk_id", words_of(F.coalesce(*[F.col(f"{p}.{n}") for p in "tr" for n in ("words", "word_timestamps")])).alias("top"))


def plain_text(df: DataFrame) -> DataFrame:
    """(chunk_id, text): the payload's text as a whole."""
    return _parts(df).select("chunk_id", clean_cue(F.coalesce("t.text", "r.text")).alias("text"))


def chunk_times(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments with their chunk's start added, unless their first one shows that times are absolute already. chunks:
    chunk_id, start, end."""
    first = df.groupBy("chunk_id").agg(F.min_by(F.struct("s", "e"), "ord").alias("f"))
    placed = first.join(chunks.select("chunk_id", F.col("start").alias("cs"), F.col("end").alias("ce")), "chunk_id")
    length = F.greatest(F.lit(0.0), F.col("ce") - F.col("cs"))
    relative = (length > 0) & (F.col("f.s") >= -1) & (F.col("f.e") <= length + 1)
    outside = (F.col("f.s") < F.col("cs") - 1) | ((F.col("ce") > F.col("cs")) & (F.col("f.s") > F.col("ce") + 1))
    absolute = (F.col("cs") != 0) & ~relative & ~outside
    offset = placed.select("chunk_id", F.when(absolute, 0.0).otherwise(F.col("cs")).alias("offset"))
    shifted = df.join(offset, "chunk_id")
    move = F.transform("words", lambda w: w.withField("start", w["start"] + F.col("offset")).withField("end", w["end"] + F.col("offset")))
    return shifted.withColumns({"s": F.col("s") + F.col("offset"), "e": F.col("e") + F.col("offset"), "words": move}).drop("offset")


def speech_from_silence_log(df: DataFrame, pad_seconds: float = 0.4) -> DataFrame:
    """df: media_id, log, duration. Speech intervals between the silences that the log reports, padded and merged:
    (media_id, s, e). A log without a complete silence is all speech."""
    marks = df.select("media_id", "duration", F.posexplode_outer(F.regexp_extract_all("log", F.lit(r"(silence_(?:start|end):\s*[0-9.]+)"), 1)).alias("ord", "m"))
    value = F.regexp_extract("m", r"([0-9.]+)$", 1).try_cast("double")
    order = Window.partitionBy("media_id").orderBy("ord")
    read = marks.withColumns({"v": value, "is_end": F.contains("m", F.lit("_end"))})
    before = F.lag(F.when(~F.col("is_end"), F.col("v"))).over(order)
    last = F.row_number().over(Window.partitionBy("media_id").orderBy(F.col("ord").desc())) == 1
    read = read.withColumns({"_from": F.coalesce(before, F.lit(0.0)), "_last": last})
    closed = read.where("is_end and v > _from").select("media_id", "duration", F.col("_from").alias("qs"), F.col("v").alias("qe"))
    ends = read.groupBy("media_id", "duration").agg(F.max("v").alias("latest")).select("media_id", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), F.col("latest"), F.lit(0.0)).alias("end"))
    some = closed.select("media_id").distinct()
    hanging = read.where("_last and not is_end").join(some, "media_id").join(ends, "media_id").where("end > v").select("media_id", "duration", F.col("v").alias("qs"), F.col("end").alias("qe"))
    quiet = closed.unionByName(hanging)
    reach = Window.partitionBy("media_id").orderBy("qs", "qe").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.max("qe").over(reach), F.lit(0.0))
    gaps = quiet.withColumn("c", cursor).where("qs > c + 0.05").select("media_id", F.col("c").alias("s"), F.col("qs").alias("e"))
    tails = quiet.groupBy("media_id").agg(F.max("qe").alias("s")).join(ends, "media_id").where("end > s + 0.05").select("media_id", "s", F.col("end").alias("e"))
    heard = pad(gaps.unionByName(tails).withColumn("ord", F.lit(0).cast("long")), pad_seconds).select("media_id", "s", "e")
    whole = ends.join(some, "media_id", "left_anti").where("end > 0").select("media_id", F.lit(0.0).alias("s"), F.col("end").alias("e"))
    return heard.unionByName(whole)
