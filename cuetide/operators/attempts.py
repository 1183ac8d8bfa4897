"""Recognition in several attempts, over a table of recorded answers instead of a service.

A request for a chunk is told apart by its form: whether it named the clips to listen to, and whether the service was to
detect speech. Which requests are made depends on what came back before, chunk by chunk: a refused request with clips is
made again without; where no speech was known to be and nothing came, one without detection is made, of which only
substantial rows count; and where known speech stays uncovered, one more, whose rows fill the gaps. Each step is a join of
the chunks with the answers they still need, so all chunks take a step at once and each stops by its own state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.functions.text import repeat_key
from cuetide.operators import guards, intervals, jobs, normalise, runs
from cuetide.operators.summary import speech_coverage
from cuetide.session import stored

ROWS = ["media_id", "ord", "s", "e", "text", "words", "compression", "no_speech", "logprob"]


def form(clip: Column, vad: Column) -> Column:
    return F.when(clip, 2).otherwise(0) + F.when(vad, 1).otherwise(0)


def _answer(chunks: DataFrame, recorded: DataFrame, wanted: Column, name: str) -> DataFrame:
    """chunks with the form that was asked for (null: none) and whether that has an answer."""
    made = recorded.where("not failed").select(F.col("chunk_id").alias("_c"), F.col("form").alias("_f"))
    asked = chunks.withColumn(name, wanted)
    return asked.join(made, (F.col("chunk_id") == F.col("_c")) & (F.col(name) == F.col("_f")), "left").withColumn(f"{name}_ok", F.col("_c").isNotNull()).drop("_c", "_f")


def _rows_of(rows: DataFrame, chunks: DataFrame, which: str, number: Column) -> DataFrame:
    """The rows of each chunk's answer of a form, with the number of the request."""
    chosen = chunks.where(F.col(which).isNotNull()).select(F.col("chunk_id").alias("_c"), F.col(which).alias("_f"), number.cast("int").alias("attempt"))
    return rows.join(chosen, (F.col("media_id") == F.col("_c")) & (F.col("form") == F.col("_f"))).drop("_c", "_f", "form")


def transcribe(chunks: DataFrame, recorded: DataFrame, speech: DataFrame, quality: bool = True, run_filters: bool = True) -> tuple[DataFrame, DataFrame]:
    """chunks: chunk_id, start, end, clip and vad (what a first request sends), precheck (speech is found out before),
    vad_supported, known (it was found out, reliably). recorded: chunk_id, clip, vad, failed, payload, one row for each form
    there is an answer for; a form without a row is one that failed. speech: media_id (the chunk), idx, s, e.

    Two tables: (media_id, ord, s, e, text, attempt), the rows that stay, with the number of the request that brought
    them; and (chunk_id, requests, plan, failed): how many requests were made, why the last one was (`without_clips_refused`,
    `empty`, `without_clips`, `with_service_vad`, null for a first one that was enough), and whether the chunk has no answer
    at all. A chunk whose last request failed keeps the rows it had."""
    told = recorded.withColumn("form", form(F.col("clip"), F.col("vad")))
    # One pass over all payloads; a chunk's form is part of the key.
    keyed = told.where("not failed").select((F.col("chunk_id") * 4 + F.col("form")).alias("chunk_id"), "payload")
    times = chunks.select("chunk_id", "start", "end").join(told.select("chunk_id", "form").distinct(), "chunk_id").select((F.col("chunk_id") * 4 + F.col("form")).alias("chunk_id"), "start", "end")
    read, _ = normalise.normalise(keyed, times, quality, run_filters)
    rows = stored(read.select(F.col("media_id").alias("_k"), *[c for c in ROWS if c != "media_id"]).select(F.floor(F.col("_k") / 4).cast("long").alias("media_id"), F.pmod("_k", F.lit(4)).cast("int").alias("form"), *ROWS[1:]), "attempt-rows")

    # The first request, and the one after a refusal.
    now = _answer(chunks, told, form(F.col("clip"), F.col("vad")), "first")
    now = _answer(now, told, F.when(~F.col("first_ok") & F.col("clip"), form(F.lit(False), F.col("vad"))), "second")
    now = now.withColumn("won", F.when(F.col("first_ok"), F.col("first")).when(F.col("second_ok"), F.col("second")))
    current = _rows_of(rows, now, "won", F.when(F.col("first_ok"), 1).otherwise(2))

    # Nothing heard where nothing was thought to be heard.
    heard = speech.select(F.col("media_id").alias("_h")).distinct()
    some = current.groupBy(F.col("media_id").alias("_n")).agg(F.count(F.lit(1)).alias("n"))
    now = now.join(heard, F.col("chunk_id") == F.col("_h"), "left").join(some, F.col("chunk_id") == F.col("_n"), "left")
    silent = F.col("known") & F.col("_h").isNull()
    due = F.col("won").isNotNull() & normalise.empty_recovery(silent, F.coalesce("n", F.lit(0)), F.col("vad"))
    now = _answer(now, told, F.when(due, form(F.lit(False), F.lit(False))), "empty")
    now = stored(now.drop("_h", "_n", "n"), "attempt-chunks")
    number = F.when(F.col("first_ok"), 2).otherwise(3)
    strict = guards.strict_recovery(_rows_of(rows, now.where("empty_ok"), "empty", number))
    current = stored(current.unionByName(strict), "attempt-current")

    # Known speech without rows.
    known = speech.join(now.where("known and won is not null").select(F.col("chunk_id").alias("_c")), F.col("media_id") == F.col("_c"), "left_semi")
    missing = speech_coverage(known, current).where("retry").select(F.col("media_id").alias("_m"))
    now = now.join(missing, F.col("chunk_id") == F.col("_m"), "left")
    sent = F.col("clip") & F.col("first_ok")
    plan = normalise.retry_plan(F.col("_m").isNotNull(), sent, F.col("clip"), F.col("vad"), F.col("precheck"), F.col("vad_supported"))
    now = now.withColumn("plan", plan).drop("_m")
    last = F.when(F.col("plan") == "without_clips", form(F.lit(False), F.col("vad"))).when(F.col("plan") == "with_service_vad", form(F.lit(False), F.lit(True)))
    now = stored(_answer(now, told, last, "third"), "attempt-plans")
    made = 1 + F.col("second").isNotNull().cast("int") + F.col("empty").isNotNull().cast("int")
    retry = _rows_of(rows, now.where("third_ok"), "third", made + 1)
    gaps = intervals.uncovered(known, current, least=0.0)
    key = repeat_key(F.col("text"))
    merged = jobs.retry_rows(current, retry, gaps, runs.repeated_keys(retry, key), key)
    why = F.coalesce("plan", F.when(F.col("empty").isNotNull(), "empty"), F.when(F.col("second").isNotNull(), "without_clips_refused"))
    outcomes = now.select("chunk_id", (made + F.col("third").isNotNull().cast("int")).alias("requests"), why.alias("plan"), F.col("won").isNull().alias("failed"))
    return merged.select("media_id", "ord", "s", "e", "text", "attempt"), outcomes
