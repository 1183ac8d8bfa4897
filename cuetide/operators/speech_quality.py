"""The chain that recognised segments go through: quality, runs, speech activity, ownership, with what each step drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuetide.operators import guards, intervals, runs
from cuetide.params import P


def speech_active(segments: DataFrame, speech: DataFrame, slack: float = P.owner_slack, media: DataFrame | None = None) -> DataFrame:
    """Segments with speech about: their middle in an interval, widened by slack, or enough of them. Media without any
    interval pass, since nothing is known of them: they get one that holds everything, so segments are computed and read
    once, in one semi-join. media: the ids among segments, where they come cheaper than from segments themselves."""
    d = F.col("e") - F.col("s")
    middle = F.col("s") + d / 2
    everything = F.lit(1e300)
    ids = (segments if media is None else media).select("media_id").distinct()
    unknown = ids.join(speech.select("media_id").distinct(), "media_id", "left_anti").select("media_id", (-everything).alias("rs"), everything.alias("re"))
    other = speech.select("media_id", F.col("s").alias("rs"), F.col("e").alias("re")).unionByName(unknown)
    shared = F.least(F.col("e"), F.col("re") + slack) - F.greatest(F.col("s"), F.col("rs") - slack)
    evident = middle.between(F.col("rs") - slack, F.col("re") + slack) | (shared >= F.least(F.lit(0.25), F.greatest(F.lit(0.05), d * 0.15)))
    named = other.withColumnRenamed("media_id", "_media")
    return segments.join(named, (F.col("media_id") == F.col("_media")) & (F.col("s") < F.col("re") + slack) & (F.col("rs") - slack < F.col("e")) & evident, "left_semi")


def clean(segments: DataFrame, speech: DataFrame) -> DataFrame:
    """segments: media_id, ord, s, e, text, no_speech, compression. What is left after quality, runs and speech."""
    sound = intervals.valid(segments).where(~guards.is_hallucinated(F.col("text"), F.col("no_speech"), F.lit(None).cast("double"), F.col("compression")))
    return speech_active(runs.drop_low_information(runs.drop_repeated_runs(sound)), speech, media=segments)


def report(segments: DataFrame, speech: DataFrame) -> DataFrame:
    """Per media: segments, those kept, seconds of speech in the union of its intervals."""
    kept = clean(segments, speech).groupBy("media_id").agg(F.count(F.lit(1)).alias("kept"))
    heard = intervals.union(speech.withColumn("ord", F.col("idx"))).groupBy("media_id").agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("e") - F.col("s")).alias("speech"))
    total = segments.groupBy("media_id").agg(F.count(F.lit(1)).alias("segments"))
    return total.join(kept, "media_id", "left").join(heard, "media_id", "left").select("media_id", "segments", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("intervals", F.lit(0)).alias("intervals"), F.coalesce("speech", F.lit(0.0)).alias("speech"))
