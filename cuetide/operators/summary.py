"""Summaries of jobs, chunks and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.operators.intervals import uncovered
from cuetide.params import P


def speech_coverage(speech: DataFrame, segments: DataFrame, least: float = P.bridge) -> DataFrame:
    """Per media: the seconds of speech in intervals of some length, those without a segment, and whether to try again."""
    real = speech.where(F.col("e") - F.col("s") >= least)
    total = real.groupBy("media_id").agg(F.sum(F.col("e") - F.col("s")).alias("speech"), F.count(F.lit(1)).alias("n"))
    gaps = uncovered(real, segments, least=0.0).groupBy("media_id").agg(F.sum(F.col("e") - F.col("s")).alias("missing"))
    found = total.join(gaps, "media_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0.0)))
    return found.withColumn("retry", F.col("missing") >= F.least(F.lit(1.0), F.greatest(F.lit(0.15), F.col("speech") * 0.25)))


DONE = ("completed", "completed_with_warnings", "failed")


def job_counters(status: DataFrame) -> DataFrame:
    """status: job_id, stage, asr_failures, translation_failures. Counters and the stage the job ends in."""
    stage = F.col("stage")
    found = status.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(stage.isin(*DONE)).alias("done"),
        F.count_if(stage == "failed").alias("failed"),
        F.count_if(stage == "asr").alias("recognising"),
        F.count_if(stage == "translation").alias("translating"),
        F.count_if((stage != "failed") & (F.col("asr_failures") > 0)).alias("partial"),
        F.sum(F.when(stage != "failed", F.col("asr_failures")).otherwise(0)).alias("lost_audio"),
        F.sum(F.when(stage == "completed_with_warnings", F.col("translation_failures")).otherwise(0)).alias("lost_lines"),
    )
    percent = F.floor(F.col("done") * 1000 / F.col("chunks") + 0.5) / 10
    warned = (F.col("failed") > 0) | (F.col("partial") > 0) | (F.col("lost_lines") > 0)
    return found.withColumns({"percent": percent, "final_stage": F.when(warned, "completed_with_warnings").otherwise("completed")})


def coverage_warning(last_end: Column, expected: Column) -> Column:
    """short, none or ok: subtitles that end long before the media does."""
    short = (expected - last_end > 120) & (last_end < expected * 0.75)
    return F.when(expected < 300, "ok").when(F.coalesce(last_end, F.lit(0.0)) <= 0, "none").when(short, "short").otherwise("ok")
