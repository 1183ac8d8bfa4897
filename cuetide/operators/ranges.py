"""Files put together from recorded responses to range requests.

A response is sliced to the bytes that were asked for where the server sent the whole file instead; one whose stated range
is not the one asked for is refused. Pieces may overlap and repeat: in order of their offsets, each adds what lies beyond
those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = r"(?i)^\s*bytes\s+(\d+)-(\d+)/(\d+|\*)\s*$"


def content_range(c: Column) -> Column:
    """A Content-Range header as offset, end (exclusive) and total (null if unknown); null if it is none."""
    part = lambda i: F.regexp_extract(c, _RANGE, i).try_cast("long")
    return F.when(c.rlike(_RANGE) & (part(2) >= part(1)), F.struct(part(1).alias("offset"), (part(2) + 1).alias("end"), part(3).alias("total")))


def pieces(responses: DataFrame) -> DataFrame:
    """responses: resource, offset, length (asked for), status, content_range, body (binary). Adds piece (the bytes asked
    for, or null), total (the file's length, as far as a response tells it) and fault: `other_range` where the server states
    another one, `other_length` where it sent another number of bytes, `refused` for other states."""
    told = responses.withColumn("_told", content_range(F.col("content_range")))
    size, end = F.octet_length("body"), F.col("offset") + F.col("length")
    partial, whole = F.col("status") == 206, F.col("status") == 200
    moved = partial & F.coalesce((F.col("_told.offset") != F.col("offset")) | (F.col("_told.end") != end), F.lit(False))
    exact = size == F.col("length")
    fits = (partial & exact) | (whole & (((F.col("offset") == 0) & exact) | (size >= end)))
    cut = F.when(partial | (exact & (F.col("offset") == 0)), F.col("body")).otherwise(F.substring("body", (F.col("offset") + 1).cast("int"), F.col("length").cast("int")))
    fault = F.when(moved, "other_range").when(partial | whole, F.when(~F.coalesce(fits, F.lit(False)), "other_length")).otherwise("refused")
    total = F.coalesce(F.when(partial, F.col("_told.total")), F.when(whole & (size >= end), size.cast("long")))
    marked = told.withColumns({"fault": fault, "total": total}).withColumn("piece", F.when(F.col("fault").isNull(), cut))
    return marked.drop("_told")


def assembled(found: DataFrame) -> DataFrame:
    """found: pieces() or its columns resource, offset, piece, total. (resource, total, size, holes, body): the bytes there are,
    in order, how many, and the spans [start, end) that no piece covers, up to the total where it is known. body is null
    where there is a hole or the total is unknown. A file is one row of the result, and held whole."""
    kept = found.where(F.col("piece").isNotNull()).select("resource", F.col("offset").cast("long").alias("a"), (F.col("offset") + F.octet_length("piece")).cast("long").alias("b"), "piece")
    order = Window.partitionBy("resource").orderBy("a", F.col("b").desc(), "piece")
    reach = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.withColumn("reach", reach)
    fresh = placed.where(F.col("b") > F.col("reach")).select("resource", "a", "b", "reach", F.substring("piece", (F.greatest(F.lit(0), F.col("reach") - F.col("a")) + 1).cast("int"), F.octet_length("piece")).alias("piece"))
    hole = F.when(F.col("a") > F.col("reach"), F.struct(F.col("reach").alias("start"), F.col("a").alias("end")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("a", "piece"))), lambda x: F.hex(x["piece"]))
    files = fresh.groupBy("resource").agg(parts.alias("parts"), F.array_sort(F.collect_list(hole)).alias("holes"), F.max("b").alias("reach"))
    totals = found.groupBy(F.col("resource").alias("_r")).agg(F.max("total").alias("total"))
    both = totals.join(files, F.col("resource") == F.col("_r"), "left")
    spans = "array<struct<start:bigint,end:bigint>>"
    reach, holes = F.coalesce("reach", F.lit(0).cast("long")), F.coalesce("holes", F.array().cast(spans)).cast(spans)
    tail = F.when(F.col("total") > reach, F.array(F.struct(reach.alias("start"), F.col("total").alias("end")))).otherwise(F.array().cast(spans))
    done = both.select(F.col("_r").alias("resource"), "total", F.concat(holes, tail.cast(spans)).alias("holes"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"))
    body = F.unhex(F.array_join("parts", ""))
    sizes = F.aggregate(F.transform("parts", lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return done.select("resource", "total", "holes", F.floor(sizes / 2).cast("long").alias("size"), F.when((F.size("holes") == 0) & F.col("total").isNotNull(), body).alias("body"))
