"""Queries that run streams over the driver's tables to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuetide.operators import jobs as batch_jobs
from cuetide.operators import retention, windows
from cuetide.plans import adapters as ad
from cuetide.plans.catalog import query
from cuetide.plans.q_media import logical_parts_sql
from cuetide.session import keep_folder, let_go, shared_dir, stored
from cuetide.streaming import jobs, keyed, upserts


def _source(spark: SparkSession, d: str, table: str) -> DataFrame:
    """The table as a stream of files."""
    schema = ad.table(spark, d, table).schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{table}.parquet*")


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    base = keep_folder(spark, f"{shared_dir(spark)}/cuetide/stream-{uuid.uuid4().hex}")
    jobs.drain(stream, f"{base}/out", f"{base}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _collected(stream: DataFrame) -> DataFrame:
    """Update mode: each batch is kept as it comes."""
    spark = stream.sparkSession
    base = keep_folder(spark, f"{shared_dir(spark)}/cuetide/stream-{uuid.uuid4().hex}")
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out/v{epoch}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*")


def _files(spark: SparkSession, rows: DataFrame, parts: list) -> DataFrame:
    """Rows as a stream that brings those that meet each condition after another. They are made once, and each condition's
    are as many files as tasks read them, which is what a batch takes; where a task finds none, a batch takes some of the
    next, which changes no result."""
    base = keep_folder(spark, f"{shared_dir(spark)}/cuetide/files-{uuid.uuid4().hex}")
    made = stored(rows, "files-made")
    for condition in parts:
        made.where(condition).write.mode("append").parquet(base)
    tasks = made.rdd.getNumPartitions()
    let_go(made)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, tasks)).parquet(base)


def _mixed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A key's rows in three batches, out of order."""
    return _files(spark, rows, ["seq % 3 = 1", "seq % 3 = 0", "seq % 3 = 2"])


def _counted(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Adds seq, a key's count of its rows."""
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


@query("st01_tab_state", """with recursive e as (select user_id as tab, row_number() over (partition by user_id order by event_id) - 1 as seq, event_id % 4 = 3 and event_id % 40 = 39 as nav, concat_ws('-', event_type, event_id % 50) as f, value as score from events),
fo as (select tab, -1::bigint as seq, []::struct(s double, q bigint, f varchar)[] as kept, []::varchar[] as gone, 0 as ignored, 0 as resets from (select distinct tab from e) union all
  select tab, seq, case when nav then [] when known then kept when len(more) > 10 then more[2:] else more end, case when nav then [] when not known and len(more) > 10 then list_append(gone, more[1].f) else gone end, case when nav then 0 else ignored + known::int end, resets + nav::int
  from (select e.*, fo.kept, fo.gone, fo.ignored, fo.resets, list_contains(fo.gone, e.f) as known, list_sort(list_append(list_filter(fo.kept, lambda x: x.f <> e.f), {'s': e.score, 'q': e.seq::bigint, 'f': e.f})) as more from fo join e on e.tab = fo.tab and e.seq = fo.seq + 1))
select tab, len(kept) as kept, len(kept) + len(gone) as seen, ignored, resets from fo qualify row_number() over (partition by tab order by seq desc) = 1""")
def st01(spark, d):
    """Events of users as candidates of tabs, one in forty a navigation."""
    i = F.col("event_id")
    events = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), i.alias("at"), F.when(i % 40 == 39, "navigate").otherwise("media").alias("kind"), F.lit(0).alias("frame"), F.concat_ws("-", "event_type", (i % 50).cast("string")).alias("fingerprint"), F.col("value").alias("score"))
    told = _collected(keyed.in_order(_mixed(spark, _counted(events, "tab", "at")), "tab", keyed.TabState(10)))
    last = told.groupBy("tab").agg(F.max_by(F.struct("*"), "applied").alias("x"))
    return last.select("tab", "x.kept", "x.seen", "x.ignored", "x.resets")


_FRAMES = "select user_id as tab, event_id % 3 as frame, row_number() over (partition by user_id order by event_id) - 1 as seq, case when event_id % 17 = 0 then 'navigate' when event_type = 'view' then 'context' else 'media' end as kind from events"


@query("st02_frames_in_stream", f"""with e as ({_FRAMES}), m as (select *, max(seq) filter (kind = 'navigate' and frame = 0) over (partition by tab) as top, max(seq) filter (kind = 'navigate') over (partition by tab, frame) as own from e),
c as (select tab, frame, max(seq) as seq from m where kind = 'context' and coalesce(seq > top, true) and coalesce(seq > own, true) group by 1, 2)
select t.tab, coalesce(string_agg(c.seq, ',' order by c.seq), '') as contexts from (select distinct tab from e) t left join c on c.tab = t.tab group by 1""")
def st02_stream(spark, d):
    """What each frame of a tab is about, after the navigations of tabs and frames."""
    i = F.col("event_id")
    kind = F.when(i % 17 == 0, "navigate").when(F.col("event_type") == "view", "context").otherwise("media")
    events = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), i.alias("at"), kind.alias("kind"), (i % 3).cast("int").alias("frame"), F.col("event_type").alias("fingerprint"), F.col("value").alias("score"))
    told = _collected(keyed.in_order(_mixed(spark, _counted(events, "tab", "at")), "tab", keyed.TabState()))
    return told.groupBy("tab").agg(F.max_by("contexts", "applied").alias("x")).select("tab", F.array_join(F.col("x").cast("array<string>"), ",").alias("contexts"))


def _line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as chunks of 400 seconds: job, n, last, core_s, core_e, failed, duration, kind."""
    lines = ad.table(spark, d, "lineitem")
    chosen = lines.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("n")).agg(F.max_by("l_returnflag", F.struct("l_partkey", "l_suppkey")).alias("flag"))
    n, last = F.col("n"), F.max("n").over(Window.partitionBy("job"))
    return chosen.select("job", "n", last.alias("last"), (n * F.lit(400.0)).alias("core_s"), (n * 400.0 + 400).alias("core_e"), (F.col("flag") == "R").alias("failed"), F.lit(None).cast("double").alias("duration"), F.lit("chunk").alias("kind"))


def _ends(chunks: DataFrame) -> DataFrame:
    """A row for the end of each job, after its last chunk."""
    return chunks.where("n = last").withColumns({"kind": F.lit("end"), "n": F.col("n") + 1, "failed": F.lit(False)})


@query("st05_translation_groups", """with c as (select l_orderkey as job, l_linenumber as chunk, l_linenumber * 400 as s, l_returnflag = 'R' as failed, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) as nth from lineitem),
k as (select *, cast(floor((s + 0.001e0) / 900e0) as bigint) as bucket from c where nth = 1), m as (select job, max(chunk) as last from k group by 1)
select job, bucket, count(*) as chunks, count(*) filter (failed) as failed, true as complete from k group by 1, 2""")
def st05(spark, d):
    """Chunks of jobs in windows of media time; the job's end closes the last."""
    chunks = _line_chunks(spark, d)
    rows = _counted(chunks.unionByName(_ends(chunks)), "job", "n")
    return _drained(keyed.in_order(_mixed(spark, rows), "job", keyed.TranslationWindows()))


@query("st06_closed_windows", """with c as (select l_orderkey as job, l_linenumber as n, l_linenumber * 400 as s, l_linenumber * 400 + 400 as e, l_returnflag = 'R' as failed, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) as nth from lineitem),
k as (select *, cast(floor((s + 0.001e0) / 900e0) as bigint) as bucket, max(e) over (partition by job) as total from c where nth = 1),
w as (select job, bucket, count(*) as chunks, count(*) filter (failed) as failed, max(e) as e, any_value(total) as total, max(bucket) over (partition by job) as newest from k group by 1, 2)
select job, bucket, chunks, failed, true as complete from w where bucket < newest or job % 3 = 0 or e + 0.001 >= case when job % 3 = 1 then least((bucket + 1) * 900, total) else (bucket + 1) * 900 end""")
def st06_closed(spark, d):
    """Windows closed by a later one, by a chunk that reaches the end (every third job knows its length), or by the job's end
    (every third has one); a window that nothing closes is not told."""
    chunks = _line_chunks(spark, d)
    total = F.max("core_e").over(Window.partitionBy("job"))
    chunks = chunks.withColumn("duration", F.when(F.col("job") % 3 == 1, total))
    rows = _counted(chunks.unionByName(_ends(chunks).where("job % 3 = 0")), "job", "n")
    return _drained(keyed.in_order(_mixed(spark, rows), "job", keyed.TranslationWindows()))


@query("st04_logical_parts", logical_parts_sql("media_id % 2 = 0 and n % 5 = 0") + """, pt as (select fo.media_id, fo.told as chunk, nb.ord, nb.s, nb.e from fo join nb on nb.media_id = fo.media_id and nb.n = fo.n where fo.told is not null)
select media_id, chunk::bigint as chunk, min(s) as s, arg_max(e, (s, ord)) as e, count(*) as parts, arg_min(ord, (s, ord)) as first, arg_max(ord, (s, ord)) as last from pt group by 1, 2""")
def st04(spark, d):
    """Parts of audio to logical chunks, as they come; each fifth part of every second media carries context."""
    ev = ad.event_segments(spark, d).where("e > s")
    known = F.col("text") != "error"
    parts = ev.select("media_id", "ord", "s", "e", (F.col("text") == "click").alias("silent"), F.when(known, F.col("s")).alias("speech_s"), F.when(known, F.col("e")).alias("speech_e"), F.lit("part").alias("kind"))
    rows = _counted(parts, "media_id", "s", "ord").withColumn("context", (F.col("media_id") % 2 == 0) & ((F.col("seq") + 1) % 5 == 0))
    ends = rows.groupBy("media_id").agg((F.max("seq") + 1).alias("seq")).withColumn("kind", F.lit("end"))
    return _drained(keyed.in_order(_mixed(spark, rows.unionByName(ends, allowMissingColumns=True)), "media_id", keyed.LogicalParts(30.0)))


@query("st06_event_windows", "select start, event_type, count(*) as n from (select date_trunc('day', ts) as start, event_type from events) where start + interval 1 day <= (select max(ts) from events) - interval 1 day group by 1, 2")
def st06(spark, d):
    """Tumbling windows that the watermark has closed."""
    events = _source(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = _drained(jobs.bucket_counts(events, "at", "1 day", "1 day", ["event_type"]))
    return found.select(F.col("window.start").alias("start"), "event_type", "n")


@query("st11_start_lock", "select event_id from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events) where before is null or epoch_us(ts) - epoch_us(before) >= 2500000")
def st11(spark, d):
    """Starts within 2.5 s of the one before are dropped."""
    return windows.without_quick_repeats(ad.table(spark, d, "events"), ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"]).select("event_id")


@query("st12_changed_signatures", "select event_id from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) where before is null or before <> event_type")
def st12(spark, d):
    """Rows whose content differs from the one before."""
    return windows.changed_only(ad.table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type")).select("event_id")


@query("st10_retry_plan", "with s as (select o_custkey as job, o_orderkey as chunk, case when o_orderstatus = 'F' then 'failed' when o_orderstatus = 'O' then 'queued' else 'completed' end as stage from orders), j as (select job, bool_or(stage = 'failed') as any_failed from s group by 1) select s.job, s.chunk from s join j using (job) where case when any_failed then stage = 'failed' else stage <> 'completed' end")
def st10(spark, d):
    """What to run again: a job's failed chunks, else its incomplete ones."""
    s = F.col("o_orderstatus")
    rows = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("chunk"), F.when(s == "F", "failed").when(s == "O", "queued").otherwise("completed").alias("stage"))
    return batch_jobs.to_run_again(rows).select("job", "chunk")


@query("st10_retry_steps", """with c as (select o_custkey as job, o_orderkey as chunk, case when o_orderstatus = 'F' and o_custkey % 3 = 0 then 'failed' when o_orderstatus = 'P' then 'translation' else 'completed' end as stage, case when o_custkey % 5 <> 1 then o_orderkey % 4 end as rows, o_orderkey % 7 <> 0 as translated, case when o_orderkey % 11 = 0 then 1 end as bad_lines, o_orderkey % 3 // 2 as bad_audio, o_orderkey % 2 = 0 as audio from orders),
l as (select *, case when stage = 'failed' then 3 when coalesce(rows, 0) > 0 and (stage <> 'completed' or not translated or coalesce(bad_lines, 0) > 0) then 2 when audio then 1 else 0 end as level from c), m as (select job, max(level) as most from l group by 1)
select l.job, chunk, case when coalesce(rows, 0) > 0 and bad_audio <= 0 then 'translate' else 'recognise' end as step from l join m using (job) where most > 0 and level = most""")
def st10_steps(spark, d):
    """What jobs run again, from the translation or from the audio."""
    s, job, chunk = F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderkey")
    rows = ad.table(spark, d, "orders").select(job.alias("job"), chunk.alias("chunk"), F.when((s == "F") & (job % 3 == 0), "failed").when(s == "P", "translation").otherwise("completed").alias("stage"), F.when(job % 5 != 1, chunk % 4).alias("source_rows"), (chunk % 7 != 0).alias("translated"), F.when(chunk % 11 == 0, 1).alias("translation_failures"), F.floor((chunk % 3) / 2).alias("asr_failures"), (chunk % 2 == 0).alias("audio"))
    return batch_jobs.retry_steps(rows)


@query("st15_replace_with_fallback", "select o_orderkey as chunk, case when o_orderkey % 3 = 0 or o_orderstatus = 'P' then o_orderpriority else lower(o_orderpriority) end as text, o_totalprice as price from orders")
def st15(spark, d):
    """New results in place of old ones; where there is none, or it is empty, the old one stays."""
    orders = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    new = orders.where("chunk % 3 <> 0").select("chunk", F.when(F.col("o_orderstatus") != "P", F.lower("text")).alias("text"))
    return batch_jobs.replaced_with_fallback(orders.drop("o_orderstatus"), new, ["chunk"], ["text"])


@query("st02_navigation", "with e as (select user_id as tab, event_id % 3 as frame, event_id as seq, case when event_id % 17 = 0 then 'navigate' when event_type = 'view' then 'context' else 'media' end as kind from events), m as (select *, max(seq) filter (kind = 'navigate' and frame = 0) over (partition by tab) as top, max(seq) filter (kind = 'navigate') over (partition by tab, frame) as own from e) select tab, seq from m where kind <> 'navigate' and coalesce(seq > top, true) and (kind <> 'context' or coalesce(seq > own, true))")
def st02(spark, d):
    """A tab's navigation forgets all, a frame's what the frame told."""
    i = F.col("event_id")
    rows = ad.table(spark, d, "events").select(F.col("user_id").alias("tab"), (i % 3).alias("frame"), i.alias("seq"), F.when(i % 17 == 0, "navigate").when(F.col("event_type") == "view", "context").otherwise("media").alias("kind"))
    return windows.after_navigation(rows).select("tab", "seq")


@query("st07_late_chunks", """with c as (select l_orderkey as job, l_linenumber as n, l_returnflag = 'R' as failed, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) as nth from lineitem),
k as (select *, max(n) over (partition by job) as last, cast(floor((n * 400 + 0.001e0) / 900e0) as bigint) as bucket from c where nth = 1),
f as (select job, bucket, count(*) as chunks, count(*) filter (failed) as failed, true as complete from k where n <> 2 or last = 2 group by 1, 2)
select * from f union all select job, bucket, 1, failed::int, not exists (select 1 from f where f.job = k.job and f.bucket = k.bucket) from k where n = 2 and last > 2""")
def st07(spark, d):
    """Each job's second chunk comes after the job's end: into a window that was told, so it is told as late, or into one that
    had no chunk before, which is told then."""
    chunks = _line_chunks(spark, d)
    late = (F.col("kind") == "chunk") & (F.col("n") == 2) & (F.col("last") > 2)
    rows = _counted(chunks.unionByName(_ends(chunks)).withColumn("_late", late), "job", "_late", "n").drop("_late")
    return _drained(keyed.in_order(_mixed(spark, rows), "job", keyed.TranslationWindows()))


@query("st09_published_progress", "select o_custkey as job, o_orderstatus as stage, count(*) as n from orders group by 1, 2")
def st09(spark, d):
    """Counts of chunks by job and stage, published anew with every batch, each key's latest kept."""
    orders = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderstatus").alias("stage"), F.col("o_orderkey").alias("chunk"))
    stream = _files(spark, orders, ["chunk % 3 = 0", "chunk % 3 = 1", "chunk % 3 = 2"])
    target = keep_folder(spark, f"{shared_dir(spark)}/cuetide/progress-{uuid.uuid4().hex}")
    counts = stream.groupBy("job", "stage").agg(F.count(F.lit(1)).alias("n"))
    jobs.publish(counts, f"{target}/table", f"{target}/checkpoint", ["job", "stage"], ["n"])
    return upserts.read(spark, f"{target}/table").select("job", "stage", "n")


@query("sk04_upserted_cache", ad.with_views(ad.CACHE_ENTRIES) + """, v as (select id % 400 as id, owner, updated, bytes, protected, id as version from ce), l as (select id, arg_max(struct_pack(owner := owner, updated := updated, bytes := bytes, protected := protected, version := version), version) as x from v group by 1),
r as (select id, x.*, row_number() over (partition by x.owner order by x.updated desc, id) as rnk from l) select id, version, not ((updated > 0 and updated < 86400 * 1040 - 30 * 86400) or rnk > 80) or protected as fresh from r""")
def sk04(spark, d):
    """Entries in three batches, an id's latest version kept, then pruned by age and rank."""
    rows = ad.cache_entries(spark, d).select((F.col("id") % 400).alias("id"), "owner", "updated", "bytes", "protected", F.col("id").alias("version"))
    stream = _files(spark, rows, ["version % 3 = 2", "version % 3 = 0", "version % 3 = 1"])
    target = keep_folder(spark, f"{shared_dir(spark)}/cuetide/cache-{uuid.uuid4().hex}")
    jobs.publish(stream, f"{target}/table", f"{target}/checkpoint", ["id"], ["version"], mode="append")
    kept = retention.prune_cache(upserts.read(spark, f"{target}/table"), F.lit(86400 * 1040), ["owner"], most_bytes=1 << 60)
    return kept.select("id", "version", F.col("kept").alias("fresh"))
