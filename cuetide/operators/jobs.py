"""Batches for translators, retries, cached results and job reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.text import clean_plain
from cuetide.params import P
from cuetide.session import ship


def batches(df: DataFrame, size: int = P.translation_batch) -> DataFrame:
    """Adds batch and pos: a media's segments in order, so many to a batch."""
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("s", "e", "ord")) - 1
    return df.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size).cast("long"), "pos": (F.col("_n") % size).cast("long")}).drop("_n")


def translate(df: DataFrame, client: Callable[[list[str]], list[dict]], depth: int = 6) -> DataFrame:
    """df: media_id, batch, pos, text. (media_id, batch, pos, text, failed). client gets texts and returns items with text
    and perhaps i; it is the caller's, and runs on executors. A batch is tried whole twice, then halved to a depth; rows
    that a good answer lacks are asked for again alone; what still fails keeps its source."""
    ship(df.sparkSession)

    def aligned(texts: list[str], items: list[dict]) -> tuple[dict[int, str], bool]:
        found, invalid = {}, False
        for pos, item in enumerate(items):
            i = item.get("i", pos)
            text = str(item.get("text") or "").strip()
            if not isinstance(i, int) or not 0 <= i < len(texts) or i in found or not text:
                invalid = True
            else:
                found[i] = text
        return found, invalid

    def solve(texts: list[str], level: int) -> list[str | None]:
        for _ in range(2 if level == 0 else 1):
            try:
                found, invalid = aligned(texts, client(texts))
            except Exception:  # noqa: BLE001  whatever a client raises is a failed request
                continue
            missing = [i for i in range(len(texts)) if i not in found]
            if not missing and not invalid:
                return [found[i] for i in range(len(texts))]
            if found and missing and level < depth:
                again = solve([texts[i] for i in missing], level + 1)
                return [found.get(i) if i in found else again[missing.index(i)] for i in range(len(texts))]
        if len(texts) == 1 or level >= depth:
            return [None] * len(texts)
        half = (len(texts) + 1) // 2
        return solve(texts[:half], level + 1) + solve(texts[half:], level + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                texts = list(r.text)
                rows += [(r.media_id, r.batch, int(pos), t if f is None else f, f is None) for pos, t, f in zip(r.pos, texts, solve(texts, 0), strict=True)]
            yield pd.DataFrame(rows, columns=["media_id", "batch", "pos", "text", "failed"])

    grouped = df.groupBy("media_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    packed = grouped.select("media_id", "batch", F.col("x.pos").alias("pos"), F.col("x.text").alias("text"))
    return packed.mapInPandas(run, "media_id long, batch long, pos long, text string, failed boolean")


def recompute_bucket(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """current without the buckets that fresh has rows of, and fresh."""
    return current.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def to_run_again(df: DataFrame, failed: str = "failed", done: str = "completed") -> DataFrame:
    """df: job, chunk, stage. What to run again: a job's failed chunks, else those that are not done."""
    some = df.groupBy(F.col("job").alias("_job")).agg(F.max(F.col("stage") == failed).alias("_any"))
    both = df.join(some, F.col("job") == F.col("_job"))
    return both.where(F.when(F.col("_any"), F.col("stage") == failed).otherwise(F.col("stage") != done)).drop("_job", "_any")


def retry_steps(df: DataFrame) -> DataFrame:
    """df: job, chunk, stage, source_rows (null or 0: none), translated (boolean), translation_failures, asr_failures, audio
    (boolean). What a job runs again, and from where: (job, chunk, step). Its failed chunks; if it has none, those with
    source rows that are not completed, not translated, or have lines that failed; if there are none of these either, all
    that have audio. A chunk with source rows and no failed audio is translated again, any other is recognised again."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = F.coalesce(F.col("stage") == "failed", F.lit(False))
    open_ = (n("source_rows") > 0) & (~F.coalesce(F.col("stage") == "completed", F.lit(False)) | ~F.coalesce("translated", F.lit(False)) | (n("translation_failures") > 0))
    level = F.when(failed, 3).when(open_, 2).when(F.coalesce("audio", F.lit(False)), 1).otherwise(0)
    # Chunks of a lower level than their job's do not run; an open chunk with audio also counts where all audio does.
    most = df.groupBy(F.col("job").alias("_job")).agg(F.max(level).alias("_most"))
    both = df.join(most, F.col("job") == F.col("_job")).where((F.col("_most") > 0) & (level == F.col("_most")))
    step = F.when((n("source_rows") > 0) & (n("asr_failures") <= 0), "translate").otherwise("recognise")
    return both.select("job", "chunk", step.alias("step"))


def replaced_with_fallback(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New values in place of old ones; where the new row is missing, or a value of it, the old one stays."""
    named = new.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"_new_{v}") for v in values])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return old.join(named, same, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])


def retry_rows(attempt: DataFrame, retry: DataFrame, gaps: DataFrame, repeated: DataFrame, key: Column) -> DataFrame:
    """Rows of a second attempt that lie in gaps of the first and are not among repeated texts (media_id, key), with the
    first attempt's."""
    d = F.col("e") - F.col("s")
    span = gaps.select(F.col("media_id").alias("_m"), F.col("s").alias("gs"), F.col("e").alias("ge"))
    shared = F.least(F.col("e"), F.col("ge") + 0.2) - F.greatest(F.col("s"), F.col("gs") - 0.2)
    inside = retry.join(span, (F.col("media_id") == F.col("_m")) & (shared > 0) & (shared >= F.least(F.lit(0.35), F.greatest(F.lit(0.08), d * 0.25))), "left_semi")
    fresh = inside.withColumn("key", key).join(repeated.select("media_id", "key"), ["media_id", "key"], "left_anti").select(*retry.columns)
    return attempt.unionByName(fresh.select(*attempt.columns))


def merge_headers(df: DataFrame, keys: list[str], order: list[str], headers: str = "headers") -> DataFrame:
    """Maps of a group merged in order, the last value of a name winning."""
    rows = df.select(*keys, F.struct(*order).alias("_o"), F.explode(headers).alias("name", "value"))
    last = rows.groupBy(*keys, "name").agg(F.max_by("value", "_o").alias("value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(headers))


def report_json(df: DataFrame) -> DataFrame:
    """(job_id, report): a job's chunks as JSON, without anything that could be a secret."""
    plain = F.regexp_replace(clean_plain(F.col("message")), r"(?i)(?:bearer\s+|key=|token=)\S+", "[removed]")
    chunk = F.struct("idx", "stage", plain.alias("message"))
    return df.groupBy("job_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks")).select("job_id", F.to_json(F.struct("job_id", "chunks")).alias("report"))
