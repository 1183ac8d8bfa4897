"""Runs of repeated or empty text, as gaps and islands. Tables have media_id, ord, s, e and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.text import information_kind, is_low_single, repeat_key, run_key_counts
from cuetide.params import P


def _order():
    return Window.partitionBy("media_id").orderBy("s", "e", "ord")


def _islands(df: DataFrame, starts) -> DataFrame:
    return df.withColumn("_new", F.when(starts, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(_order())).drop("_new")


def drop_repeated_runs(df: DataFrame) -> DataFrame:
    """Without runs of one text: at least run_min_count neighbours that together last run_min_seconds."""
    keyed = df.withColumn("_key", repeat_key(F.col("text")))
    before = F.lag("_key").over(_order())
    runs = _islands(keyed, before.isNull() | (before != F.col("_key")) | (F.col("_key") == ""))
    own = Window.partitionBy("media_id", "_island")
    bad = run_key_counts(F.col("_key")) & (F.count(F.lit(1)).over(own) >= P.run_min_count) & (F.sum(F.greatest(F.lit(0.0), F.col("e") - F.col("s"))).over(own) >= P.run_min_seconds)
    return runs.withColumn("_bad", bad).where(~F.col("_bad")).drop("_key", "_island", "_bad")


def drop_spread_repeats(df: DataFrame, suspicious, weak) -> DataFrame:
    """Without texts that recur over a long span and look wrong too often. suspicious, weak: boolean columns of a row."""
    keyed = df.withColumns({"_key": repeat_key(F.col("text")), "_suspicious": suspicious, "_weak": suspicious | weak})
    order = F.struct("s", "ord")
    by_key = keyed.where(run_key_counts(F.col("_key"))).groupBy("media_id", "_key").agg(F.count(F.lit(1)).alias("n"), (F.max_by("e", order) - F.min("s")).alias("span"), F.count_if("_suspicious").alias("odd"), F.count_if("_weak").alias("weak"))
    bad = (F.col("span") >= P.spread_min_span) & (F.col("n") >= P.spread_min_count) & (
        ((F.col("n") >= P.spread_high_count) & (F.col("span") >= P.spread_high_span))
        | ((F.col("n") >= P.spread_medium_count) & (F.col("span") >= P.spread_medium_span) & (F.col("weak") >= P.spread_medium_weak) & (F.col("weak") / F.col("n") >= P.spread_medium_weak_share))
        | ((F.col("odd") >= P.spread_suspicious) & (F.col("odd") / F.col("n") >= P.spread_suspicious_share))
    )
    dropped = by_key.where(bad).select("media_id", "_key")
    return keyed.join(dropped, ["media_id", "_key"], "left_anti").drop("_key", "_suspicious", "_weak").select(*df.columns)


def drop_low_information(df: DataFrame) -> DataFrame:
    """Without lone low-information rows at the head of a run, and without what is left of runs that are long enough."""
    seconds = F.greatest(F.lit(0.0), F.col("e") - F.col("s"))
    marked = df.withColumn("_kind", information_kind(F.col("text"))).withColumn("_single", is_low_single(F.col("_kind"), F.col("text"), seconds))
    # A row without a kind is alone: it closes the island before it and starts none.
    runs = marked.withColumn("_island", F.sum(F.when(F.col("_kind").isNull(), 1).otherwise(0)).over(_order()))
    own = Window.partitionBy("media_id", "_island", F.col("_kind").isNull())
    ordered = own.orderBy("s", "e", "ord")
    head = F.min(F.when(F.col("_single"), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    kept = runs.withColumn("_head", head).where((F.col("_kind").isNull() & ~F.col("_single")) | (F.col("_kind").isNotNull() & (F.col("_head") == 0)))
    first, last = F.min_by("s", F.struct("s", "e", "ord")).over(own), F.max_by("e", F.struct("s", "e", "ord")).over(own)
    span, n = F.greatest(F.lit(0.0), last - first), F.count(F.lit(1)).over(own)
    all_marks = F.min(F.when(F.col("_kind") == "punctuation", 1).otherwise(0)).over(own) == 1
    bad = F.col("_kind").isNotNull() & F.when(all_marks, (n >= P.punctuation_run_count) & (span >= P.punctuation_run_span)).otherwise((n >= P.low_run_count) & (span >= P.low_run_span))
    return kept.withColumn("_bad", bad).where(~F.col("_bad")).select(*df.columns)


def repeated_keys(df: DataFrame, key, least_span: float = 6.0) -> DataFrame:
    """Keys of six characters or more that occur twice or more over a span: (media_id, key, n)."""
    keyed = df.withColumn("key", key).where(F.length("key") >= P.run_min_chars)
    return keyed.groupBy("media_id", "key").agg(F.count(F.lit(1)).alias("n"), (F.max("e") - F.min("s")).alias("span")).where((F.col("n") >= 2) & (F.col("span") >= least_span))


def dropped_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """EXCEPT ALL that keeps the rows: those of before beyond as many equal ones as after has. Equal: media, times to the
    millisecond, text; the first ones are matched."""
    same = ["media_id", "_s", "_e", "text"]
    key = {"_s": F.floor(F.col("s") * 1000 + 0.5), "_e": F.floor(F.col("e") * 1000 + 0.5)}
    left = before.withColumns(key).withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("ord")))
    right = after.withColumns(key).groupBy(*same).agg(F.count(F.lit(1)).alias("_have"))
    return left.join(right, same, "left").where(F.coalesce("_have", F.lit(0)) < F.col("_n")).select(*before.columns)
