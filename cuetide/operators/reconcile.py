"""Source segments and their translations brought together.

Tables have media_id, ord (place in its list), s, e, text, and chunk and seg, the identity, either of which may be null.
A row without both has no identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.functions.text import clean_plain

MODES = ("panel", "bilingual", "live")


def _numbered(df: DataFrame, prefix: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("media_id").orderBy("ord")) - 1
    key = F.when(F.col("chunk").isNotNull() & F.col("seg").isNotNull(), F.concat_ws(":", F.col("chunk").cast("string"), F.col("seg").cast("string")))
    return df.withColumns({"_place": place, "_key": key}).select(*[F.col(c).alias(prefix + c) for c in ("media_id", "_place", "_key", "s", "e", "text")])


def reconcile(source: DataFrame, translated: DataFrame, mode: str = "panel") -> DataFrame:
    """Full outer join by identity: (media_id, src_s, src_e, src_text, tra_s, tra_e, tra_text). Of translations with one
    identity the last counts. A media without any identity is zipped by place.

    panel: a source row without a match takes the translation without identity at its place; other such translations go.
    bilingual: they stay as rows of their own. live: rows without identity have their place as one."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    src, tra = _numbered(source, "src_"), _numbered(translated, "tra_")
    known = src.select(F.col("src_media_id").alias("_m"), F.col("src__key").alias("_k")).union(tra.select("tra_media_id", "tra__key"))
    keyed = known.groupBy("_m").agg(F.max(F.col("_k").isNotNull()).alias("_keyed"))
    fallback = lambda side: F.concat(F.lit("fallback:"), F.col(f"{side}__place").cast("string"))
    src = src.join(keyed, F.col("src_media_id") == F.col("_m")).drop("_m")
    tra = tra.join(keyed.withColumnRenamed("_keyed", "_tkeyed"), F.col("tra_media_id") == F.col("_m")).drop("_m")
    if mode == "live":
        src = src.withColumn("_id", F.coalesce("src__key", fallback("src")))
        tra = tra.withColumn("_tid", F.coalesce("tra__key", fallback("tra")))
    else:
        own = lambda side, flag: F.when(F.col(flag), F.col(f"{side}__key")).otherwise(fallback(side))
        src, tra = src.withColumn("_id", own("src", "_keyed")), tra.withColumn("_tid", own("tra", "_tkeyed"))
    # Earlier translations with an identity that a later one has too are dropped; those without one are all distinct.
    lone = F.col("_tid").isNull()
    nth = F.row_number().over(Window.partitionBy("tra_media_id", F.coalesce("_tid", F.concat(F.lit("lone:"), F.col("tra__place").cast("string")))).orderBy(F.col("tra__place").desc()))
    tra = tra.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    joined = src.join(tra.where(~lone), (F.col("src_media_id") == F.col("tra_media_id")) & (F.col("_id") == F.col("_tid")), "full_outer")
    rest = tra.where(lone)
    names = ["media_id", "src_s", "src_e", "src_text", "tra_s", "tra_e", "tra_text"]
    done = joined.withColumn("media_id", F.coalesce("src_media_id", "tra_media_id"))
    if mode == "bilingual":
        alone = rest.select(F.col("tra_media_id").alias("media_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("src_s", "double"), ("src_e", "double"), ("src_text", "string"))], "tra_s", "tra_e", "tra_text")
        return done.select(*names).unionByName(alone.select(*names))
    if mode == "panel":
        spare = rest.select(F.col("tra_media_id").alias("_sm"), F.col("tra__place").alias("_sp"), F.col("tra_s").alias("_ss"), F.col("tra_e").alias("_se"), F.col("tra_text").alias("_st"))
        free = F.col("tra_media_id").isNull() & (F.col("src_media_id") == F.col("_sm")) & (F.col("src__place") == F.col("_sp"))
        done = done.join(spare, free, "left").withColumns({"tra_s": F.coalesce("tra_s", "_ss"), "tra_e": F.coalesce("tra_e", "_se"), "tra_text": F.coalesce("tra_text", "_st")})
    return done.select(*names)


def display_rows(merged: DataFrame) -> DataFrame:
    """Live display: the translation in place of its source, (media_id, s, e, text)."""
    has = F.col("tra_s").isNotNull()
    pick = lambda a, b: F.when(has, F.col(a)).otherwise(F.col(b))
    return merged.select("media_id", pick("tra_s", "src_s").alias("s"), pick("tra_e", "src_e").alias("e"), pick("tra_text", "src_text").alias("text"))


def cues(merged: DataFrame) -> DataFrame:
    """Cues: translated text, else the source's, which is source_only then; source_text where it differs."""
    clean = merged.withColumns({"_t": clean_plain(F.col("tra_text")), "_o": clean_plain(F.col("src_text"))})
    named = clean.select("media_id", F.coalesce("tra_s", "src_s").alias("s"), F.coalesce("tra_e", "src_e").alias("e"), F.when(F.col("_t") != "", F.col("_t")).otherwise(F.col("_o")).alias("text"), "_o", ((F.col("_t") == "") & (F.col("_o") != "")).alias("source_only"))
    kept = named.where((F.col("text") != "") & F.col("s").isNotNull() & F.col("e").isNotNull())
    shown = F.when(F.col("source_only") | (F.col("_o") != F.col("text")), F.col("_o")).otherwise("")
    return kept.select("media_id", "s", "e", "text", shown.alias("source_text"), "source_only")


def shown_cues(df: DataFrame, mode: str = "translated", fallback: bool = True) -> DataFrame:
    """Cues that a display mode shows. Where a media has any translation, translated mode leaves source-only cues out;
    where it has none, fallback decides."""
    if mode == "source":
        return df.where((F.col("source_text") != "") | F.col("source_only"))
    if mode == "bilingual":
        return df
    real = F.max(~F.col("source_only")).over(Window.partitionBy("media_id"))
    return df.withColumn("_real", real).where(~F.col("source_only") | (~F.col("_real") & F.lit(fallback))).drop("_real")


def cue_lines(mode: str = "translated") -> Column:
    """The text of a cue as lines joined by a line break."""
    origin = F.when(F.col("source_text") != "", F.col("source_text")).when(F.col("source_only"), F.col("text")).otherwise("")
    if mode == "source":
        return origin
    if mode == "bilingual":
        return F.when((origin != "") & (origin != F.col("text")), F.concat_ws("\n", origin, F.col("text"))).otherwise(F.col("text"))
    return F.col("text")


def align(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """items: batch_id, pos, i (null: pos stands), text. sizes: batch_id, n. A row per index of a batch: its text, null if
    it is missing; and per batch the invalid items (out of range, repeated or empty)."""
    text = clean_plain(F.col("text"))
    placed = items.join(sizes, "batch_id").withColumns({"idx": F.coalesce("i", "pos"), "clean": text})
    fits = (F.col("idx") >= 0) & (F.col("idx") < F.col("n")) & (F.col("clean") != "")
    nth = F.row_number().over(Window.partitionBy("batch_id", "idx", fits).orderBy("pos"))
    marked = placed.withColumns({"fits": fits, "nth": nth})
    # An item is only a repeat if an earlier one took its index; empty and misplaced ones take none.
    good = marked.where("fits and nth = 1").select("batch_id", "idx", "clean")
    bad = marked.where("not (fits and nth = 1)").groupBy("batch_id").agg(F.count(F.lit(1)).alias("invalid"))
    wanted = sizes.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return wanted.join(good, ["batch_id", "idx"], "left").join(bad, "batch_id", "left").select("batch_id", "idx", F.col("clean").alias("text"), F.coalesce("invalid", F.lit(0).cast("long")).alias("invalid"))
