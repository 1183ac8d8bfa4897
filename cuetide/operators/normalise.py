"""From a recogniser's payload to sound segments: the normaliser, the guard against what was not said, and the plans that
tell which of their filters run and what is asked for again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.text import information_kind, is_low_single
from cuetide.functions.times import overlap, round_seconds
from cuetide.operators import folds, guards, intervals, runs
from cuetide.params import P
from cuetide.sources import speech as payloads

# Names under which recognisers give a segment's quality.
_QUALITY = {
    "compression": ["compression_ratio", "compressionRatio"],
    "no_speech": ["no_speech_prob", "noSpeechProbability"],
    "logprob": ["avg_logprob", "avg_log_probability", "avg_log_prob", "average_logprob", "average_log_probability", "logprob", "log_prob"],
}


def quality_of(raw: Column) -> Column:
    """A segment's quality (compression, no_speech, logprob) from its JSON text, whatever the names; null if it has none."""
    read = {name: F.coalesce(*[F.get_json_object(raw, f"$.{k}").try_cast("double") for k in keys]) for name, keys in _QUALITY.items()}
    some = F.coalesce(*read.values()).isNotNull()
    return F.when(some, F.struct(*[c.alias(name) for name, c in read.items()]))


def refine_with_words(segments: DataFrame, words: DataFrame, margin: float = 0.05) -> DataFrame:
    """segments: chunk_id, s, e, words and more. words: chunk_id, top (array of start, end, text, probability), what the
    payload gives beside its segments. Segments in which such words lie take them over, and their bounds."""
    named = words.select(F.col("chunk_id").alias("_chunk"), "top")
    both = segments.join(named, F.col("chunk_id") == F.col("_chunk"), "left")
    inside = F.filter(F.coalesce("top", F.array().cast(segments.schema["words"].dataType)), lambda w: (w["end"] > F.col("s") + margin) & (w["start"] < F.col("e") - margin))
    marked = both.withColumn("_w", inside)
    some = F.size("_w") > 0
    moved = {
        "words": F.when(some, F.col("_w")).otherwise(F.col("words")),
        "s": F.when(some, F.array_min(F.transform("_w", lambda w: w["start"]))).otherwise(F.col("s")),
        "e": F.when(some, F.array_max(F.transform("_w", lambda w: w["end"]))).otherwise(F.col("e")),
    }
    return marked.withColumns(moved).select(*segments.columns)


def _from_words(words: DataFrame) -> DataFrame:
    """Segments of payloads that give words alone."""
    rows = words.select("chunk_id", F.posexplode("top").alias("ord", "w")).select(F.col("chunk_id").alias("media_id"), F.col("ord").cast("long").alias("ord"), "w.start", "w.end", "w.text")
    made = folds.sentences(rows.select("media_id", "ord", F.col("start").alias("s"), F.col("end").alias("e"), "text"))
    none = F.lit(None).cast("double")
    return made.select(F.col("media_id").alias("chunk_id"), F.col("idx").alias("ord"), "s", "e", "text", F.array().cast("array<struct<start:double,end:double,text:string,probability:double>>").alias("words"), none.alias("compression"), none.alias("no_speech"), none.alias("logprob"))


def normalise(df: DataFrame, chunks: DataFrame, quality: bool = True, run_filters: bool = True) -> tuple[DataFrame, DataFrame]:
    """df: chunk_id, payload. chunks: chunk_id, start, end. (segments: media_id (the chunk), ord, part, s, e, text, words,
    compression, no_speech, logprob; failures: chunk_id, reason). Read, refined by words, placed in time, cut at gaps
    between words, then by quality and by runs. A failure is a payload with text but without any time."""
    top = payloads.top_words(df)
    read = payloads.read_payloads(df)
    named = read.select("chunk_id").distinct()
    segments = refine_with_words(read, top)
    spoken = _from_words(top.join(named, "chunk_id", "left_anti").where(F.size("top") > 0))
    timed = payloads.chunk_times(segments.unionByName(spoken), chunks)
    rows = intervals.valid(timed.withColumnRenamed("chunk_id", "media_id").where("text <> ''"))
    cut = guards.split_at_word_gaps(rows.select("media_id", "ord", "s", "e", "text", "words", "compression", "no_speech", "logprob"))
    kept = cut
    if quality:
        kept = kept.where(~guards.is_hallucinated(F.col("text"), F.col("no_speech"), F.col("logprob"), F.col("compression")))
    if run_filters:
        kept = runs.drop_low_information(runs.drop_repeated_runs(kept))
    text = payloads.plain_text(df)
    without = text.join(cut.select(F.col("media_id").alias("chunk_id")).distinct(), "chunk_id", "left_anti").where("text <> ''")
    return kept, without.select("chunk_id", F.lit("text without times").alias("reason"))


def evidence(segments: DataFrame, speech: DataFrame, known: DataFrame) -> DataFrame:
    """segments: media_id, ord, s, e and more. speech: media_id, s, e. known: media_id, those whose speech was found out
    reliably, also where there was none. Adds known, heard (it has speech at all), strong (enough of it in the segment) and
    alone (far from any)."""
    spans = segments.select("media_id", "ord", "s", "e")
    shared = intervals.speech_overlap(spans, speech).select(F.col("media_id").alias("_m"), F.col("ord").alias("_o"), "speech")
    near = intervals.nearest_speech(spans, speech).select(F.col("media_id").alias("_m2"), F.col("ord").alias("_o2"), "silence_before", "silence_after")
    some = speech.select(F.col("media_id").alias("_m3")).distinct().withColumn("_heard", F.lit(True))
    told = known.select(F.col("media_id").alias("_m4")).distinct().withColumn("_known", F.lit(True))
    both = segments.join(shared, (F.col("media_id") == F.col("_m")) & (F.col("ord") == F.col("_o")), "left").join(near, (F.col("media_id") == F.col("_m2")) & (F.col("ord") == F.col("_o2")), "left")
    both = both.join(some, F.col("media_id") == F.col("_m3"), "left").join(told, F.col("media_id") == F.col("_m4"), "left")
    d = F.col("e") - F.col("s")
    seconds = F.coalesce("speech", F.lit(0.0))
    far = lambda c: F.coalesce(F.col(c) > P.silence, F.lit(True))
    added = {
        "known": F.coalesce("_known", F.lit(False)),
        "heard": F.coalesce("_heard", F.lit(False)),
        "strong": (d > 0) & intervals.strong_speech(seconds, d),
        "alone": (d > 0) & (seconds < F.least(F.lit(0.35), d * 0.2)) & far("silence_before") & far("silence_after"),
    }
    return both.withColumns(added).select(*segments.columns, *added)


def hallucination_guard(segments: DataFrame, speech: DataFrame, known: DataFrame, run_filters: bool = True) -> DataFrame:
    """segments: media_id, ord, s, e, text, words, compression, no_speech, logprob. Without those whose words and times
    cannot be speech, whatever is known of it; and without those that, where speech is known, lack it and look like nothing
    that was said."""
    stats = evidence(guards.word_stats(segments), speech, known)
    single = is_low_single(information_kind(F.col("text")), F.col("text"), guards.seconds())
    vad = guards.is_vad_hallucination()
    weak_text = (F.col("text_chars") >= P.coverage_min_chars) & (F.col("weak") > 0) & (F.col("coverage") < 0.7)
    unlike = single | F.when(F.col("heard"), (guards.weak_evidence() | vad) & F.col("alone")).otherwise(weak_text | vad)
    worded = F.size(F.filter(F.coalesce("words", F.array().cast(segments.schema["words"].dataType)), lambda w: w["end"] > w["start"])) > 0
    odd = guards.is_word_anomaly()
    unheard = F.col("known") & ~F.col("strong")
    bad = guards.is_severe_timing() | guards.coverage_suspicious() | (unheard & unlike) | (unheard & F.col("heard") & ~worded)
    bad = bad | (odd & F.col("known") & F.when(F.col("heard"), ~F.col("strong") & F.col("alone")).otherwise(True))
    kept = stats.where(~F.coalesce(bad, F.lit(False))).select(*segments.columns)
    return runs.drop_low_information(runs.drop_repeated_runs(kept)) if run_filters else kept


def clamp_words(segments: DataFrame, speech: DataFrame, error: float = 0.3, shortest: float = 0.1) -> DataFrame:
    """segments: media_id, ord, words. speech: media_id, idx, s, e. Words drawn in to the speech about them, those mostly
    in silence left out, and a new part begun after a long gap, or a shorter one between two intervals of speech: (media_id,
    ord, part, s, e, text, words_n)."""
    words = segments.select("media_id", "ord", F.posexplode(guards.content_words_or_marks(F.col("words"))).alias("i", "w")).select("media_id", "ord", "i", F.col("w.start").alias("s"), F.col("w.end").alias("e"), F.col("w.text").alias("text"))
    other = speech.select("media_id", "idx", F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = intervals.overlap_join(words, other)
    shared = overlap(F.col("s"), F.col("e"), F.col("rs"), F.col("re"))
    found = pairs.groupBy("media_id", "ord", "i", "s", "e", "text").agg(F.sum(shared).alias("heard"), F.min(F.greatest("s", "rs")).alias("cs"), F.max(F.least("e", "re")).alias("ce"), F.max_by("idx", F.struct(shared, -F.col("idx"))).alias("idx"))
    d = F.col("e") - F.col("s")
    share = F.col("heard") / d
    silent = (share < 1 - error) & (F.col("heard") < F.least(F.lit(0.2), F.greatest(F.lit(0.03), d * (1 - error))))
    cut_off = (F.col("ce") - F.col("cs") < shortest) & (share < 0.8)
    kept = found.where(~silent & ~cut_off)
    order = Window.partitionBy("media_id", "ord").orderBy("i")
    gap = F.col("cs") - F.lag("ce").over(order)
    new = (gap > P.word_gap_split) | ((gap > P.vad_split_silence) & (F.lag("idx").over(order) != F.col("idx")))
    parts = kept.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).withColumn("part", F.sum("_new").over(order))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    made = parts.groupBy("media_id", "ord", "part").agg(F.min("cs").alias("s"), F.max("ce").alias("e"), joined.alias("t"), F.count(F.lit(1)).alias("words_n"))
    from cuetide.functions.text import join_words

    return made.select("media_id", "ord", "part", "s", "e", join_words(F.col("t")).alias("text"), "words_n").where("text <> ''")


def speech_windows(speech: DataFrame, media: DataFrame, upload: float = P.upload_seconds, context: float = P.context_seconds) -> DataFrame:
    """speech: media_id, s, e, ord. media: media_id, duration, known (its speech was found out). Upload windows about speech:
    greedy, each core starts with speech and is cut evenly where it is too long, then widened. Media known to be silent
    have none; those of which nothing is known have fixed windows. (media_id, core_s, core_e, s, e)."""
    core = max(1.0, upload - 2 * context)
    named = media.select(F.col("media_id").alias("_m"), "duration", "known")
    clean = speech.join(named, F.col("media_id") == F.col("_m")).select("media_id", "ord", round_seconds(F.greatest(F.lit(0.0), F.col("s"))).alias("s"), round_seconds(F.least(F.col("duration"), F.col("e"))).alias("e"))
    cores = folds.clip_windows(clean, core)
    steps = F.sequence(F.lit(0), F.ceil((F.col("e") - F.col("s") - 0.001) / core).cast("int") - 1)
    cut = cores.where(F.col("e") - F.col("s") > 0.001).select("media_id", F.col("e").alias("_end"), F.col("s").alias("_start"), F.explode(steps).alias("k"))
    placed = cut.select("media_id", (F.col("_start") + F.col("k") * core).alias("core_s"), F.least("_end", F.col("_start") + (F.col("k") + 1) * core).alias("core_e"))
    wide = placed.join(named, F.col("media_id") == F.col("_m")).select("media_id", "core_s", "core_e", round_seconds(F.greatest(F.lit(0.0), F.col("core_s") - context)).alias("s"), round_seconds(F.least(F.col("duration"), F.col("core_e") + context)).alias("e"))
    spoken = clean.where("e > s").select("media_id").distinct()
    unknown = media.where(~F.coalesce("known", F.lit(False))).join(spoken, "media_id", "left_anti")
    fixed = intervals.fixed_windows(unknown, F.col("duration"), upload, context).select("media_id", "core_s", "core_e", "s", "e")
    return wide.unionByName(fixed)


def context_overlap(groups: DataFrame, segments: DataFrame, context: float = P.context_seconds, most: int = P.group_count, seconds: float = P.group_seconds) -> DataFrame:
    """groups: media_id, grp, s, e. segments: media_id, ord, s, e. Each group's segments and, before and after them, those
    within the context, the nearest first, as long as count and length stay within what a group may hold: (media_id, grp,
    ord, is_core)."""
    wide = groups.select(F.col("media_id").alias("_m"), "grp", F.col("s").alias("gs"), F.col("e").alias("ge"))
    near = segments.join(wide, (F.col("media_id") == F.col("_m")) & (F.col("s") < F.col("ge") + context) & (F.col("e") > F.col("gs") - context))
    core = (F.col("s") >= F.col("gs") - 0.001) & (F.col("e") <= F.col("ge") + 0.001)
    far = F.when(core, 0.0).otherwise(F.greatest(F.col("gs") - F.col("e"), F.col("s") - F.col("ge"), F.lit(0.0)))
    order = Window.partitionBy("media_id", "grp").orderBy(~core, far, "s", "ord")
    ranked = near.withColumns({"is_core": core, "_n": F.row_number().over(order), "_used": F.sum(F.col("e") - F.col("s")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where(F.col("is_core") | ((F.col("_n") <= most) & (F.col("_used") <= seconds + 2 * context))).select("media_id", "grp", "ord", "is_core")


def filter_policy(clip: Column, vad_filter: Column, native: Column, collected: Column) -> Column:
    """Which filters run after a request, by its form: activity only for the service's own detection, quality for none
    that detected speech, runs for all but clips. Fixed values: the names of the modes."""
    mature = clip | vad_filter | native | collected
    mode = F.when(clip, "external_vad_clip").when(vad_filter, "compatible_vad_filter").when(native, "speaches_native").when(collected, "collected_external_vad").otherwise("direct")
    return F.struct(mode.alias("mode"), (native & ~clip & ~collected).alias("activity_filter"), (~mature).alias("quality_filters"), (~clip).alias("run_filters"))


def retry_plan(missing: Column, clip_sent: Column, clip_wanted: Column, vad_sent: Column, precheck: Column, vad_supported: Column) -> Column:
    """What to ask for again where reliable speech is not covered: without clips if they were sent, with the service's
    detection if neither was and it can; null if nothing."""
    return F.when(~missing, None).when(clip_wanted & clip_sent, "without_clips").when(~clip_sent & ~vad_sent & precheck & vad_supported, "with_service_vad")


def empty_recovery(known_silent: Column, segments: Column, vad_sent: Column) -> Column:
    """Whether a strict second attempt is due: no speech was found before, the service filtered, and nothing came."""
    return known_silent & (segments == 0) & vad_sent


def combine_attempts(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two attempts' rows (media_id, ord, s, e, text) as one list without duplicates, and counts per media: first_n,
    second_n, final_n, merged_n."""
    merged = folds.merge_duplicates(first.unionByName(second))
    count = lambda df, name: df.groupBy("media_id").agg(F.count(F.lit(1)).alias(name))
    counts = count(first, "first_n").join(count(second, "second_n"), "media_id", "full").join(count(merged, "final_n"), "media_id", "full").na.fill(0)
    return merged, counts.withColumn("merged_n", F.col("first_n") + F.col("second_n") - F.col("final_n"))
