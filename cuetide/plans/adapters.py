"""The driver's tables seen as timed text and media events, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of 2024-01-01, from which the events' media time counts, an hour being a second.
_EPOCH = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: media_id, ord, s, e, text, no_speech, compression."""
    k = F.get_json_object("props", "$.k").cast("int")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH) / F.lit(3.6e9)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"),
        F.col("event_id").alias("ord"),
        start.alias("s"),
        (start + F.col("value") / F.lit(10.0)).alias("e"),
        F.col("event_type").alias("text"),
        (k / F.lit(100.0)).alias("no_speech"),
        (k / F.lit(10.0)).alias("compression"),
    )


EVENT_SEGMENTS = f"""ev as (
  select user_id as media_id, event_id as ord, (epoch_us(ts) - {_EPOCH}) / 3.6e9 as s,
         (epoch_us(ts) - {_EPOCH}) / 3.6e9 + value / 10e0 as e, event_type as text,
         cast(json_extract_string(props, '$.k') as int) / 100e0 as no_speech,
         cast(json_extract_string(props, '$.k') as int) / 10e0 as compression
  from events)"""


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech intervals: the purchases and signups of a media, numbered in order of time."""
    from pyspark.sql import Window

    own = event_segments(spark, sf_dir).where("text in ('purchase', 'signup') and e > s")
    return own.select("media_id", (F.row_number().over(Window.partitionBy("media_id").orderBy("s", "e", "ord")) - 1).cast("long").alias("idx"), "s", "e")


SPEECH = """sp as (
  select media_id, row_number() over (partition by media_id order by s, e, ord) - 1 as idx, s, e
  from ev where text in ('purchase', 'signup') and e > s)"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments to be held against speech: views and clicks."""
    return event_segments(spark, sf_dir).where("text in ('view', 'click') and e > s")


VIEWS = """sg as (select * from ev where text in ('view', 'click') and e > s)"""


def doc_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue per line: media_id, ord, s, e, text."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("media_id", F.col("pos").cast("long").alias("ord"), (F.col("pos") * F.lit(4.0)).alias("s"), (F.col("pos") * F.lit(4.0) + F.lit(3.5)).alias("e"), "text")


DOC_CUES = """lines as (
  select doc_id as media_id, unnest(string_split(text, chr(10))) as text,
         unnest(range(len(string_split(text, chr(10))))) as ord
  from documents),
cu as (select media_id, ord, ord * 4e0 as s, ord * 4e0 + 3.5e0 as e, text from lines)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their speaker: media_id, ord, s, e, text, speaker; each lasts 0.06 s a character, half a second at least."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), F.greatest(F.lit(50), F.length("text") * 6).alias("c"), "text", F.col("role").alias("speaker"))
    end = F.sum("c").over(Window.partitionBy("media_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return own.select("media_id", "ord", ((end - F.col("c")) / F.lit(100.0)).alias("s"), (end / F.lit(100.0)).alias("e"), "text", "speaker")


TURNS = """tn as (
  select media_id, ord, (t - c) / 100e0 as s, t / 100e0 as e, text, speaker from (
    select *, sum(c) over (partition by media_id order by ord rows unbounded preceding) as t from (
      select conv_id as media_id, turn as ord, greatest(50, length(text) * 6) as c, text, role as speaker from conversations)))"""


def bilingual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as the source and assistant turns as its translation: media_id, chunk, seg, ord, s, e, text."""
    from pyspark.sql import Window

    all_turns = turns(spark, sf_dir).where("speaker in ('user', 'assistant')")
    numbered = all_turns.withColumn("seg", (F.row_number().over(Window.partitionBy("media_id", "speaker").orderBy("ord")) - 1).cast("long")).withColumn("chunk", F.lit(0).cast("long"))
    part = lambda who: numbered.where(F.col("speaker") == who).select("media_id", "chunk", "seg", "ord", "s", "e", "text")
    return part("user"), part("assistant")


BILINGUAL = """bi as (
  select *, 0 as chunk, row_number() over (partition by media_id, speaker order by ord) - 1 as seg
  from tn where speaker in ('user', 'assistant')),
src as (select media_id, chunk, seg, ord, s, e, text from bi where speaker = 'user'),
tra as (select media_id, chunk, seg, ord, s, e, text from bi where speaker = 'assistant')"""


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries by source: id, owner, updated (a day per doc_id), bytes, protected."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), F.when(F.col("doc_id") % 97 == 0, 0).otherwise(F.col("doc_id") % 60 * 86400 + 86400 * 1000).cast("long").alias("updated"), (F.col("n_chars") * 40).alias("bytes"), (F.col("doc_id") % 31 == 0).alias("protected"))


CACHE_ENTRIES = """ce as (
  select doc_id as id, source as owner, case when doc_id % 97 = 0 then 0 else doc_id % 60 * 86400 + 86400 * 1000 end as updated,
         n_chars * 40 as bytes, doc_id % 31 = 0 as protected from documents)"""


def with_views(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
