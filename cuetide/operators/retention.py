"""Retention: what stays under limits of age, number and size, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuetide.params import P


def keep_best(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in an order; Spark cuts each partition to them before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def running_sums(df: DataFrame, keys: list[str], slot: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name `name_before`, its sum over the rows of the same keys that come before a row, and `name_total`, over
    all of them. slot must not fall along the order; rows of one slot are the most that a task sorts, and of a key only a row
    per slot, so a key with very many rows is split between tasks. Null sums count as 0."""
    sums = {name: F.coalesce(c, F.lit(0)) for name, c in sums.items()}
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    per = df.groupBy(*named, slot.alias("_s")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    own = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    earlier = own.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    told = per.select(*[f"_k{i}" for i in range(len(keys))], "_s", *[c for name in sums for c in (F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_b_{name}"), F.sum(name).over(own).alias(f"{name}_total"))])
    placed = df.withColumn("_slot", slot)
    same = F.col("_slot").eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(told, same).withColumns({f"{name}_before": F.col(f"_b_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()})
    return found.drop("_slot", "_s", *[f"_k{i}" for i in range(len(keys))], *[f"_b_{name}" for name in sums])


#: Seconds of a slot, in which entries of one owner are ordered by one task.
SLOT = 3600


def prune_cache(df: DataFrame, now: Column, owner: list[str], days: int = P.cache_days, most: int = P.cache_entries, most_bytes: int = P.cache_bytes, slot: int = SLOT) -> DataFrame:
    """df: id, updated (epoch seconds, 0 if unknown), bytes, protected. Adds kept: rows expire by age (not at time 0), then
    by rank of recency, then oldest first until the rest's bytes fit. A protected row always stays; if it fails age or
    rank, its bytes don't count."""
    ranked = running_sums(df, owner, -F.floor(F.col("updated") / slot), [F.col("updated").desc(), F.col("id")], {"_newer": F.lit(1)})
    old = (F.col("updated") > 0) & (F.col("updated") < now - days * 86400)
    ranked = ranked.withColumn("_out", old | (F.col("_newer_before") >= most))
    counted = F.when(~F.col("_out"), F.col("bytes")).otherwise(0)
    evictable = F.when(~F.col("_out") & ~F.col("protected"), F.col("bytes")).otherwise(0)
    sized = running_sums(ranked, owner, F.floor(F.col("updated") / slot), [F.col("updated"), F.col("id").desc()], {"_all": counted, "_free": evictable})
    evicted = F.col("_out") | (F.col("_all_total") - F.col("_free_before") > most_bytes)
    return sized.withColumn("kept", F.col("protected") | ~evicted).select(*df.columns, "kept")


def prune_audio(df: DataFrame, now: Column, owner: list[str], hours: int = P.audio_cache_hours, most_bytes: int = P.audio_cache_bytes, slot: int = SLOT) -> DataFrame:
    """df: url, cached (epoch seconds), bytes, running. Adds kept. Rows of running jobs stay and don't count."""
    old = ~F.col("running") & (F.col("cached") > 0) & (now - F.col("cached") > hours * 3600)
    counts = F.when(~old & ~F.col("running"), F.col("bytes")).otherwise(0)
    sized = running_sums(df, owner, F.floor(F.col("cached") / slot), [F.col("cached"), F.col("url")], {"_all": counts})
    kept = F.col("running") | (~old & (F.col("_all_total") - F.col("_all_before") <= most_bytes))
    return sized.withColumn("kept", kept).select(*df.columns, "kept")


#: How far a source of candidates is trusted.
SOURCE_RANKS = {"bilibili-playurl": 9, "media-element": 8, "json-parse": 7, "xhr-body": 6, "response": 5, "request": 4, "request-headers": 3, "performance-entry": 2, "page": 1}
POSITIVE_ONLY = ("duration", "size", "videoWidth", "videoHeight", "bandwidth")


def source_rank(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_RANKS.items() for x in pair]), c), F.lit(0))


def upsert(df: DataFrame, keys: list[str], seq: str, texts: list[str] = (), numbers: list[str] = (), source: str | None = None) -> DataFrame:
    """Events folded to one row per key, in order of seq: the last non-empty text, the last positive number, the source of
    the highest rank (the latest of equals), first_seq, last_seq and events."""
    last = lambda c, ok: F.max_by(c, F.when(ok, F.col(seq))).alias(c)
    aggregates = [last(c, F.col(c).isNotNull() & (F.trim(c) != "")) for c in texts]
    aggregates += [last(c, F.col(c) > 0) for c in numbers]
    if source:
        aggregates.append(F.max_by(source, F.when(F.col(source).isNotNull(), F.struct(source_rank(F.col(source)), F.col(seq)))).alias(source))
    return df.groupBy(*keys).agg(*aggregates, F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("events"))
