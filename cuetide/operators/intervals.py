"""Interval algebra on segments. Tables have media_id, s, e (seconds) and ord, which settles ties.

Everything is keyed by media_id; windows run within a media and interval joins have it as their equi key. With `bucket`,
joins add a time bucket, so that a media with very many rows is split between tasks; a pair is kept in the one bucket
that holds the later of its two starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.times import overlap, round_seconds
from cuetide.params import P


def valid(df: DataFrame) -> DataFrame:
    """Rows with finite times and a positive length."""
    return df.where(F.col("s").isNotNull() & F.col("e").isNotNull() & ~F.isnan("s") & ~F.isnan("e") & (F.col("e") > F.col("s")))


def union(df: DataFrame, bridge: float = P.bridge, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """Merge intervals that overlap or lie at most bridge apart: (keys, s, e, members)."""
    order = Window.partitionBy(*keys).orderBy("s", "e", "ord")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("s") > reach + bridge), 1).otherwise(0)
    islands = valid(df).withColumn("_new", starts).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("members")).drop("_island")


def normalised_array(c: Column) -> Column:
    """An array of (start, end): bad ones out, sorted. Null stays null, which means unknown, not silent."""
    clean = F.transform(c, lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    return F.array_sort(F.filter(clean, lambda x: x["end"] > x["start"]))


def merged_array(c: Column, bridge: float = P.bridge) -> Column:
    """The union of one row's intervals."""
    kind = "array<struct<start:double,end:double>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (F.size(acc) > 0) & (x["start"] <= last["end"] + bridge)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return F.aggregate(normalised_array(c), F.array().cast(kind), step)


def clip(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """What of each interval lies within [start, end]."""
    return valid(df.withColumns({"s": F.greatest(F.col("s"), start), "e": F.least(F.col("e"), end)}))


def pad(df: DataFrame, pad_seconds: float = P.pad, bridge: float = P.bridge) -> DataFrame:
    """Widen intervals by a pad; where two would meet, each takes half of the silence between. Then the union."""
    order = Window.partitionBy("media_id").orderBy("s", "e", "ord")
    rounded = valid(df.withColumns({"s": round_seconds(F.greatest(F.lit(0.0), F.col("s"))), "e": round_seconds(F.col("e"))}))
    before, after = F.col("s") - F.lag("e").over(order), F.lead("s").over(order) - F.col("e")
    room = lambda gap: F.when(gap.isNull() | (gap >= 2 * pad_seconds), F.lit(pad_seconds)).otherwise(F.greatest(F.lit(0.0), gap / 2))
    wider = rounded.withColumns({"_left": room(before), "_right": room(after)})
    wider = wider.withColumns({"s": round_seconds(F.greatest(F.lit(0.0), F.col("s") - F.col("_left"))), "e": round_seconds(F.col("e") + F.col("_right"))})
    return union(wider.drop("_left", "_right"), bridge)


def overlap_join(left: DataFrame, right: DataFrame, slack: float = 0.0, bucket: float | None = None, how: str = "inner") -> DataFrame:
    """Pairs of left (media_id, s, e, ...) and right (media_id, rs, re, ...) rows that overlap once right is widened."""
    condition = (F.col("s") < F.col("re") + slack) & (F.col("rs") - slack < F.col("e"))
    if bucket is None:
        other = right.withColumnRenamed("media_id", "_media")
        return left.join(other, (F.col("media_id") == F.col("_media")) & condition, how).drop("_media")
    if how != "inner":
        raise ValueError("bucketed joins are inner")
    spans = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    a = left.withColumn("_bucket", spans(F.col("s"), F.col("e")))
    b = right.withColumnRenamed("media_id", "_media").withColumn("_slot", spans(F.col("rs") - slack, F.col("re") + slack))
    once = F.col("_bucket") == F.floor(F.greatest(F.col("s"), F.col("rs") - slack) / bucket)
    return a.join(b, (F.col("media_id") == F.col("_media")) & (F.col("_bucket") == F.col("_slot")) & condition & once).drop("_media", "_bucket", "_slot")


def speech_overlap(segments: DataFrame, speech: DataFrame, slack: float = 0.05) -> DataFrame:
    """Each segment (media_id, ord, s, e) with the seconds of speech in it; widened intervals may count twice."""
    other = speech.select(F.col("media_id"), F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = overlap_join(segments, other, slack, how="left")
    seconds = F.sum(F.when(F.col("rs").isNotNull(), overlap(F.col("s"), F.col("e"), F.col("rs") - slack, F.col("re") + slack)).otherwise(0.0))
    return pairs.groupBy("media_id", "ord", "s", "e").agg(seconds.alias("speech"))


def strong_speech(seconds: Column, duration: Column) -> Column:
    need = F.least(F.lit(1.0), F.greatest(F.lit(0.35), duration * 0.45))
    return (seconds >= need) | (seconds / duration >= 0.55)


def best_interval(items: DataFrame, speech: DataFrame) -> DataFrame:
    """For each item (media_id, ord, s, e) the number of the interval (media_id, idx, s, e) that holds most of it, the
    first of equals; -1 if none does."""
    other = speech.select("media_id", F.col("idx"), F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = overlap_join(items, other, how="left")
    seconds = F.when(F.col("idx").isNotNull(), overlap(F.col("s"), F.col("e"), F.col("rs"), F.col("re")))
    best = F.max_by("idx", F.when(seconds > 0, F.struct(seconds, -F.col("idx"))))
    return pairs.groupBy("media_id", "ord", "s", "e").agg(F.coalesce(best, F.lit(-1)).alias("interval"))


def nearest_speech(segments: DataFrame, speech: DataFrame) -> DataFrame:
    """Each segment with the silence before it and after it (null: no speech on that side). Both as-of lookups are running
    extremes over the two tables in one order, so nothing is joined."""
    marks = segments.select("media_id", "ord", "s", "e", F.lit(1).alias("_own"))
    ends = speech.select("media_id", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("e"), F.lit(0).alias("_own"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    both = marks.withColumns({"_s": F.lit(None).cast("double"), "_e": F.lit(None).cast("double")}).unionByName(ends)
    back = Window.partitionBy("media_id").orderBy(F.when(F.col("_own") == 1, F.col("s")).otherwise(F.col("_e")), "_own").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("media_id").orderBy(F.when(F.col("_own") == 1, F.col("e")).otherwise(F.col("_s")).desc(), "_own").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_before": F.max("_e").over(back), "_after": F.min("_s").over(ahead)}).where("_own = 1")
    return found.select("media_id", "ord", "s", "e", (F.col("s") - F.col("_before")).alias("silence_before"), (F.col("_after") - F.col("e")).alias("silence_after"))


def uncovered(speech: DataFrame, segments: DataFrame, slack: float = 0.35, least: float = 0.08) -> DataFrame:
    """Parts of speech intervals (media_id, idx, s, e) that no segment, widened by slack, covers: (media_id, idx, s, e)."""
    other = valid(segments).select("media_id", (F.col("s") - slack).alias("rs"), (F.col("e") + slack).alias("re"))
    pairs = overlap_join(speech, other, how="left")
    spans = pairs.select("media_id", "idx", "s", "e", F.when(F.col("rs").isNotNull(), F.greatest("s", "rs")).alias("cs"), F.when(F.col("rs").isNotNull(), F.least("e", "re")).alias("ce"))
    order = Window.partitionBy("media_id", "idx").orderBy("cs", "ce")
    reach = F.coalesce(F.max("ce").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("s"))
    gaps = spans.withColumn("_reach", reach)
    inner = gaps.where(F.col("cs") > F.col("_reach")).select("media_id", "idx", F.col("_reach").alias("s"), F.col("cs").alias("e"))
    tails = spans.groupBy("media_id", "idx", "e").agg(F.coalesce(F.max("ce"), F.min("s")).alias("s")).where("s < e").select("media_id", "idx", "s", "e")
    return inner.unionByName(tails).where(F.col("e") - F.col("s") >= least)


def fixed_windows(df: DataFrame, duration: Column, upload: float = P.upload_seconds, context: float = P.context_seconds) -> DataFrame:
    """Windows over [0, duration]: cores of upload - 2 * context seconds, widened by the context and clamped. Adds idx,
    core_s, core_e, s, e."""
    core = max(1.0, upload - 2 * context)
    count = F.ceil((duration - 0.001) / core).cast("int")
    placed = df.where(duration > 0.001).withColumn("idx", F.explode(F.sequence(F.lit(0), count - 1)))
    placed = placed.withColumns({"core_s": F.col("idx") * core, "core_e": F.least(duration, (F.col("idx") + 1) * core)})
    return placed.withColumns({"s": round_seconds(F.greatest(F.lit(0.0), F.col("core_s") - context)), "e": round_seconds(F.least(duration, F.col("core_e") + context))})


def point_lookup(points: DataFrame, cues: DataFrame, tolerance: float = 0.0, bucket: float = 60.0) -> DataFrame:
    """points: media_id, point_id, t. cues: media_id, ord, s, e. The cue at each time: the latest start, then the last
    ord; the media's last cue also holds its end. -1 where there is none. Cues may overlap, so this is a join, by media and
    by a bucket of time: a point meets the cues of its bucket alone."""
    last = cues.groupBy("media_id").agg(F.max("ord").alias("_last"))
    spans = cues.where("e > s").join(last, "media_id").select(F.col("media_id").alias("_media"), "ord", "s", "e", (F.col("ord") == F.col("_last")).alias("_is_last"))
    spans = spans.withColumn("_slot", F.explode(F.sequence(F.floor((F.col("s") - tolerance) / bucket), F.floor((F.col("e") + tolerance) / bucket))))
    inside = (F.col("t") + tolerance >= F.col("s")) & ((F.col("t") < F.col("e")) | (F.col("_is_last") & (F.col("t") <= F.col("e") + tolerance)))
    pairs = points.join(spans, (F.col("media_id") == F.col("_media")) & (F.floor(F.col("t") / bucket) == F.col("_slot")) & inside, "left")
    return pairs.groupBy("media_id", "point_id", "t").agg(F.coalesce(F.max_by("ord", F.when(F.col("s").isNotNull(), F.struct("s", "ord"))), F.lit(-1)).alias("cue"))


def as_of_piece(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """points: map_id, point_id, t. pieces: map_id, out_s, out_e, src_s, src_e. Times of a shortened timeline restored:
    the first piece that ends after t, else the last one, and its linear scale. A map's pieces don't overlap, so in order
    of ends the first one is that with the smallest end. Points and pieces stand in one order, and nothing is joined."""
    piece = F.struct("out_s", "out_e", "src_s", "src_e")
    marks = points.select("map_id", "point_id", "t", F.col("t").alias("_at"), F.lit(0).alias("_piece"), F.lit(None).cast("struct<out_s:double,out_e:double,src_s:double,src_e:double>").alias("p"))
    ends = pieces.select("map_id", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(None).cast("double").alias("t"), F.col("out_e").alias("_at"), F.lit(1).alias("_piece"), piece.cast("struct<out_s:double,out_e:double,src_s:double,src_e:double>").alias("p"))
    # From the last end down; of equal ends a piece comes after the point, which it does not end after.
    order = Window.partitionBy("map_id").orderBy(F.col("_at").desc(), "_piece", F.col("p.out_s").desc())
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    own = F.last("p", ignorenulls=True).over(before)
    latest = F.max_by("p", F.when(F.col("p").isNotNull(), F.struct("p.out_s", "p.out_e"))).over(Window.partitionBy("map_id"))
    chosen = marks.unionByName(ends).withColumn("_p", F.coalesce(own, latest)).where("_piece = 0").select("map_id", "point_id", "t", F.col("_p").alias("p"))
    scale = (F.col("p.src_e") - F.col("p.src_s")) / (F.col("p.out_e") - F.col("p.out_s"))
    return chosen.select("map_id", "point_id", "t", F.coalesce(F.col("p.src_s") + (F.col("t") - F.col("p.out_s")) * scale, F.col("t")).alias("source_t"))
