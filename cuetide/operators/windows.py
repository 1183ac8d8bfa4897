"""Tumbling buckets of media time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.params import P


def bucket_of(seconds, size: float = P.translation_seconds):
    """The bucket of a core start; starts a hair before a boundary belong to the bucket after it."""
    return F.floor((F.greatest(F.lit(0.0), seconds) + 0.001) / size).cast("long")


def without_quick_repeats(df: DataFrame, keys: list[str], at: Column, order: list[str], micros: int = 2_500_000) -> DataFrame:
    """Starts that come sooner after the one before than a lock holds are dropped. at: microseconds."""
    gap = at - F.lag(at).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= micros)).drop("_gap")


def changed_only(df: DataFrame, keys: list[str], order: list[str], content: Column) -> DataFrame:
    """Rows whose content differs from the one before them, told by its digest."""
    digest = F.sha2(content.cast("binary"), 256)
    marked = df.withColumn("_digest", digest)
    before = F.lag("_digest").over(Window.partitionBy(*keys).orderBy(*order))
    return marked.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("_digest"))).drop("_digest", "_before")


def after_navigation(df: DataFrame) -> DataFrame:
    """df: tab, frame, seq, kind (navigate or other). What a tab still knows: its events after its last navigation; of what
    frames own (kind `context`), only events after the frame's own last one too."""
    tab = Window.partitionBy("tab")
    own = Window.partitionBy("tab", "frame")
    moved = F.when(F.col("kind") == "navigate", F.col("seq"))
    marked = df.withColumns({"_top": F.max(F.when(F.col("frame") == 0, moved)).over(tab), "_frame": F.max(moved).over(own)})
    alive = F.coalesce(F.col("seq") > F.col("_top"), F.lit(True)) & ((F.col("kind") != "context") | F.coalesce(F.col("seq") > F.col("_frame"), F.lit(True)))
    return marked.where(alive & (F.col("kind") != "navigate")).drop("_top", "_frame")


def translation_buckets(df: DataFrame, size: float = P.translation_seconds) -> DataFrame:
    """(media_id, bucket, cues, end): the end is the bucket's, or the media's if that comes first."""
    placed = df.withColumn("bucket", bucket_of(F.col("s"), size))
    found = placed.groupBy("media_id", "bucket").agg(F.count(F.lit(1)).alias("cues"), F.max("e").alias("_e"))
    return found.withColumn("end", F.least((F.col("bucket") + 1) * F.lit(size), F.col("_e"))).drop("_e")
