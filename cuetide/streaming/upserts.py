"""Tables that streams upsert into, one row per key, and that can be read at any time.

Rows lie in buckets by a hash of their keys, each bucket in a folder of its own. A batch writes the buckets it touches to new
folders, then a new list of all buckets' folders; the newest finished list is the table, so a reader sees a batch whole or
not at all. Folders that neither of the last two lists names are deleted, so a reader has the time of one batch to finish.
When a bucket comes to hold more than `bucket_rows` rows on average, the number of buckets doubles, and that one batch
rewrites the table: a batch's work is bounded by the keys it has, not by the table. Lists have a row per bucket; they and
nothing else come to the driver. A table has one writer, as a stream has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.session import let_go, stored

_LIST = "bucket int, buckets int, path string, n long"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the finished lists."""
    files, place = _folder(spark, f"{target}/lists")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    done = lambda name: files.exists(spark._jvm.org.apache.hadoop.fs.Path(place, f"{name}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and done(n))


def _list(spark: SparkSession, target: str, version: int) -> list:
    return spark.read.schema(_LIST).parquet(f"{target}/lists/{version:012d}").collect()


def read(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """The table as the last finished batch left it. schema is needed where there may have been none."""
    versions = _versions(spark, target)
    paths = [r.path for r in _list(spark, target, versions[-1])] if versions else []
    if not paths:
        if schema is None:
            raise ValueError(f"nothing was written to {target}")
        return spark.createDataFrame([], schema)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(*paths)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in the order; of equal ones the greatest row, so that the choice is no accident."""
    best = F.max_by(F.struct("*"), F.struct(*order, F.xxhash64("*")))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_x")).select("_x.*")


def upsert_batch(target: str, keys: list[str], order: list[str], buckets: int = 16, bucket_rows: int = 1_000_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps one row per key, the last in the order. A batch that runs again changes nothing
    more. Keys may be null; a column `_bucket` is the table's own."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = stored(latest(batch, keys, order), "upsert-fresh")
        if fresh.isEmpty():
            let_go(fresh)
            return
        versions = _versions(spark, target)
        now = _list(spark, target, versions[-1]) if versions else []
        count = grown = now[0].buckets if now else buckets
        while sum(r.n for r in now) > grown * bucket_rows:
            grown *= 2
        place = F.pmod(F.xxhash64(*keys), F.lit(grown)).cast("int")
        touched = {r[0] for r in fresh.select(place.alias("b")).distinct().collect()}  # at most one for each bucket
        old = [r for r in now if grown != count or r.bucket in touched]
        merged = fresh
        if old:
            merged = latest(spark.read.schema(fresh.schema).parquet(*[r.path for r in old]).unionByName(fresh), keys, order)
        folder = f"{target}/data/{uuid.uuid4().hex}"
        merged.withColumn("_bucket", place).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        new = spark.read.parquet(folder).groupBy("_bucket").count().collect()
        gone = {r.path for r in old}
        rows = [tuple(r) for r in now if r.path not in gone] + [(r["_bucket"], grown, f"{folder}/_bucket={r['_bucket']}", r["count"]) for r in new]
        version = versions[-1] + 1 if versions else 0
        spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{target}/lists/{version:012d}")
        for earlier in versions[:-1]:
            for path in {r.path for r in _list(spark, target, earlier)} - {r[2] for r in rows} - {r.path for r in now}:
                files, there = _folder(spark, path)
                files.delete(there, True)
            files, there = _folder(spark, f"{target}/lists/{earlier:012d}")
            files.delete(there, True)
        let_go(fresh)

    return write
