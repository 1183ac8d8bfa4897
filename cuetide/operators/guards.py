"""Tests of recognised segments: whether text, timing and words can be speech.

Rows have s, e, text, words (array of start, end, text, probability; may be null) and compression, no_speech, logprob
(null where not given).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.functions.text import content_length, information_kind, is_low_single, is_punctuation, let, repeat_key
from cuetide.functions.times import overlap
from cuetide.params import P



def seconds() -> Column:
    return F.greatest(F.lit(0.0), F.col("e") - F.col("s"))


def content_words(words: Column) -> Column:
    some = F.coalesce(words, F.array().cast("array<struct<start:double,end:double,text:string,probability:double>>"))
    return F.filter(some, lambda w: ~is_punctuation(w["text"]) & (w["end"] > w["start"]))


def content_words_or_marks(words: Column) -> Column:
    """Words of a positive length, marks included."""
    return F.filter(F.coalesce(words, F.array().cast("array<struct<start:double,end:double,text:string,probability:double>>")), lambda w: w["end"] > w["start"])


def is_hallucinated(text: Column, no_speech: Column, logprob: Column, compression: Column) -> Column:
    """Likely silence decides by the log probability, where there is one, before the compression is looked at."""
    long_enough = F.length(repeat_key(text)) >= P.run_min_chars
    by_probability = (no_speech > P.no_speech_limit) & logprob.isNotNull()
    return F.coalesce(long_enough & F.when(by_probability, logprob <= P.log_probability_limit).otherwise(compression >= P.compression_limit), F.lit(False))


def _word_chars(w: Column) -> Column:
    return content_length(F.array_join(F.transform(w, lambda x: x["text"]), ""))


def _measures(w: Column, text_chars: Column, word_chars: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(w).cast("long"),
        "coverage": F.when(text_chars > 0, word_chars / text_chars).otherwise(1.0),
        "weak": F.size(F.filter(w, lambda x: x["probability"] < P.low_probability)).cast("long"),
        "longest": F.coalesce(F.array_max(F.transform(w, lambda x: x["end"] - x["start"])), F.lit(0.0)),
    }


def word_stats(df: DataFrame) -> DataFrame:
    """Adds w, the content words, and n_words, coverage, weak (words of low probability), longest, text_chars."""
    w = F.col("w")
    with_words = df.withColumn("w", content_words(F.col("words"))).withColumns({"text_chars": content_length(F.col("text")), "word_chars": _word_chars(w)})
    return with_words.withColumns(_measures(w, F.col("text_chars"), F.col("word_chars")))


def coverage_suspicious() -> Column:
    return (F.col("text_chars") >= P.coverage_min_chars) & (F.col("word_chars") > 0) & (F.col("coverage") < P.coverage_min_ratio)


def weak_evidence() -> Column:
    weak = F.col("weak")
    some = (weak >= 1) & ((seconds() >= 3) | (F.col("longest") >= 2.5) | (F.col("n_words") <= 2))
    sparse = (weak >= 1) & (F.col("text_chars") >= 10) & (F.col("coverage") < 0.7)
    return (F.col("n_words") > 0) & (F.col("text_chars") >= P.run_min_chars) & (coverage_suspicious() | sparse | (weak >= 2) | some)


def anomaly_score(word: Column) -> Column:
    d = word["end"] - word["start"]
    low = F.when(word["probability"] < P.low_probability, 1.0).otherwise(0.0)
    return low + F.when(d < P.short_word, (P.short_word - d) * 15).otherwise(0.0) + F.when(d > P.long_word, d - P.long_word).otherwise(0.0)


def is_word_anomaly(w: Column | str = "w") -> Column:
    first = F.slice(w, 1, 8)
    total = F.aggregate(first, F.lit(0.0), lambda a, x: a + anomaly_score(x))
    return (F.size(first) > 0) & ((total >= P.anomaly_score) | (total + 0.01 >= F.size(first)))


def is_suspicious_timing(w: Column | str = "w") -> Column:
    first = F.slice(w, 1, 8)

    def weak(x: Column) -> Column:
        d = x["end"] - x["start"]
        return F.coalesce(x["probability"] < P.weak_probability, F.lit(False)) | (d < P.short_word) | (d > P.long_word)

    return (F.size(first) >= 2) & (F.size(F.filter(first, weak)) >= 2)


def is_severe_timing() -> Column:
    """Few words, one of them very long, or likely silence with odd timing."""
    low = F.size(F.filter("w", lambda x: x["probability"] < P.weak_probability))
    very_long = F.col("longest") >= F.least(F.lit(6.0), F.greatest(F.lit(3.5), seconds() * 0.45))
    silent = F.coalesce(F.col("no_speech") >= P.no_speech_limit, F.lit(False)) & (is_suspicious_timing() | ((seconds() >= 8) & (F.col("n_words") <= 8) & (F.col("longest") >= 3)))
    return (seconds() >= 6) & F.col("n_words").between(1, 12) & ((very_long & ((seconds() >= 10) | (low > 0))) | silent)


def is_vad_hallucination() -> Column:
    return F.coalesce((F.col("compression") >= P.vad_compression_limit) & (F.col("no_speech") >= P.vad_no_speech_limit), F.lit(False))


def owned_by_core(s: Column, e: Column, core_s: Column, core_e: Column) -> Column:
    """Whether a chunk's core owns a segment: overlap, or drift by a little; far too long ones need half of themselves in
    it. True where there is no core."""
    d = e - s
    inside = overlap(s, e, core_s, core_e)
    near = overlap(s, e, core_s - P.ownership_pad, core_e + P.ownership_pad)
    drift = (near > 0) & (d <= P.ownership_max_drift) & (near >= F.least(F.lit(0.35), F.greatest(F.lit(P.ownership_min_overlap), d * 0.12)))
    abnormal = (d > F.greatest(F.lit(45.0), F.greatest(F.lit(0.0), core_e - core_s) * 1.5)) & (inside / d < 0.5)
    return F.coalesce((e > s) & ~abnormal & ((inside > 0) | drift), core_s.isNull() & core_e.isNull())


def is_fragmented_cjk(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), repeat_key), lambda x: x != "")
    cjk = F.filter(parts, lambda x: x.rlike(r"\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}|\p{IsHangul}"))
    short = F.size(F.filter(cjk, lambda x: F.length(x) <= 2))
    return (F.size(parts) >= 2) & (content_length(text) >= 3) & (F.size(cjk) >= 2) & (short / F.greatest(F.size(parts), F.lit(1)) >= 0.6)


def strict_recovery(df: DataFrame) -> DataFrame:
    """Rows of a second attempt that are substantial: short, informative, and with sound words unless strongly evidenced.
    Texts that are short enough are looked at, once each: what the tests share is bound in steps, since a filter over columns
    would spell each column out at each of its uses, and the words within it again."""
    text = F.col("text")
    at_least = lambda c, v: F.coalesce(c >= v, F.lit(True))
    at_most = lambda c, v: F.coalesce(c <= v, F.lit(True))

    def measured(w: Column) -> Column:
        return let(F.struct(content_length(text).alias("chars"), _word_chars(w).alias("said")), lambda n: let(F.struct(n["chars"].alias("text_chars"), is_fragmented_cjk(text).alias("fragmented"), *[c.alias(name) for name, c in _measures(w, n["chars"], n["said"]).items()]), lambda x: kept(w, x)))

    def kept(w: Column, x: Column) -> Column:
        chars, n, weak, longest = x["text_chars"], x["n_words"], x["weak"], x["longest"]
        substantial = (chars >= 10) & (n >= 6) & (weak == 0) & (longest <= 1) & at_least(F.col("logprob"), -0.75) & at_most(F.col("no_speech"), 0.58)
        compact = ~x["fragmented"] & (chars >= 5) & (n >= 5) & (x["coverage"] >= 0.8) & (weak <= 1) & (longest <= 0.75) & F.coalesce(F.col("logprob") >= -0.45, F.lit(False)) & at_most(F.col("no_speech"), 0.8) & at_most(F.col("compression"), 2.5)
        silent = F.coalesce(F.col("no_speech") >= 0.5, F.lit(False))
        short = F.coalesce((chars <= 2) & (F.col("no_speech") >= 0.35), F.lit(False))
        middling = (chars < 14) & (F.coalesce(F.col("logprob") <= -0.5, F.lit(False)) | ((weak > 0) & (longest >= 1)))
        fragment = short | (silent & (x["fragmented"] | F.when(chars < 10, ~compact).otherwise(~compact & middling)))
        odd = is_word_anomaly(w) | is_suspicious_timing(w)
        informative = let(F.struct(information_kind(text).alias("kind")), lambda k: k["kind"].isNull() & ~is_low_single(k["kind"], text, seconds()))
        return ~fragment & (~odd | substantial | compact) & informative

    fits = (seconds() > 0) & (seconds() <= 8) & (text != "")
    return df.where(F.when(fits, let(content_words(F.col("words")), measured)).otherwise(False))


def split_at_word_gaps(df: DataFrame, gap: float = P.word_gap_split, least: float = P.word_gap_min_segment) -> DataFrame:
    """Long segments cut where no word is said for long: (media_id, ord, part, s, e, text, words), and df's further columns,
    which all parts of a row share. Islands of words within the row's own array."""
    rest = [c for c in df.columns if c not in ("media_id", "ord", "part", "s", "e", "text", "words")]
    words = content_words(F.col("words"))
    kind = "array<array<struct<start:double,end:double,text:string,probability:double>>>"

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        before = F.try_element_at(last, F.lit(-1))
        new = F.coalesce(w["start"] - before["end"] > gap, F.lit(True))
        return F.when(new, F.concat(acc, F.array(F.array(w)))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(w))))).cast(kind)

    groups = F.when(F.col("e") - F.col("s") >= least, F.aggregate(F.col("w"), F.array().cast(kind), step)).otherwise(F.array().cast(kind))
    cut = df.withColumn("w", words).withColumn("g", groups)
    whole = cut.where("size(g) < 2").select("media_id", "ord", F.lit(0).alias("part"), "s", "e", "text", "words", *rest)
    parts = cut.where("size(g) >= 2").select("media_id", "ord", F.posexplode("g").alias("part", "words"), *rest)
    bounds = parts.select("media_id", "ord", "part", F.array_min(F.transform("words", lambda x: x["start"])).alias("s"), F.array_max(F.transform("words", lambda x: x["end"])).alias("e"), F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"), "words", *rest)
    return whole.unionByName(bounds)
