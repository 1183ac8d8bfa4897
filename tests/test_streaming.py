"""Keyed streams against sequential twins, whatever the batches."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from cuetide.operators import folds, windows
from cuetide.session import shared_dir
from cuetide.streaming import keyed


def run(spark, rows, schema, key, rule, batches, arrow=10_000, until=None):
    """The rule's rows, when the input comes in the given batches, and Arrow batches have so many rows. A query with a clock
    does not end: with until it runs on until there are so many rows."""
    base = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    for batch in batches:
        spark.createDataFrame([rows[i] for i in batch], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow))
    try:
        found = keyed.in_order(stream, key, rule)
        sink = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        if until is None:
            query = sink.trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        else:
            query = sink.start()
            end = time.monotonic() + 60
            while time.monotonic() < end and len(query.recentProgress) < len(batches) + 1 or spark.read.schema(found.schema).parquet(f"{base}/out").count() < until:
                assert query.isActive and time.monotonic() < end
                time.sleep(0.5)
            query.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return spark.read.schema(found.schema).parquet(f"{base}/out")


def cut(draw, count, batches):
    """Row numbers in random order, in so many batches, some of them twice."""
    order = list(range(count))
    draw.shuffle(order)
    order += draw.sample(order, count // 10)
    return [order[k::batches] for k in range(batches)]


SPLITS = [(1, 1, 10_000), (2, 2, 7), (3, 5, 3)]


# Tabs

TAB = "tab long, seq long, kind string, frame int, fingerprint string, score double"


def tab_rows(draw, tabs=3, events=160):
    kinds = ["media"] * 12 + ["context"] * 3 + ["navigate"]
    return [(t, s, draw.choice(kinds), draw.choice([0, 1, 1, 2, None]), draw.choice([None, *(f"f{k}" for k in range(40))]), draw.choice([None, 0.0, 1.0, 2.5, draw.random()])) for t in range(tabs) for s in range(events)]


def plain_tabs(rows, most):
    state = {}
    for tab, seq, kind, frame, fingerprint, score in sorted(rows, key=lambda r: r[:2]):
        kept, gone, frames, counts = state.setdefault(tab, ({}, set(), {}, {"ignored": 0, "resets": 0}))
        if kind == "navigate" and not frame:
            kept.clear()
            gone.clear()
            frames.clear()
            counts["ignored"], counts["resets"] = 0, counts["resets"] + 1
        elif kind == "navigate":
            frames.pop(frame, None)
        elif kind == "context":
            frames[frame or 0] = seq
        elif fingerprint in gone:
            counts["ignored"] += 1
        elif fingerprint is not None:
            kept[fingerprint] = (score or 0.0, seq)
            if len(kept) > most:
                worst = min(kept, key=lambda f: kept[f])
                del kept[worst]
                gone.add(worst)
    return {t: (len(k), len(k) + len(g), c["ignored"], c["resets"], sorted(f.values())) for t, (k, g, f, c) in state.items()}


@pytest.mark.parametrize("seed,batches,arrow", SPLITS)
def test_tabs_do_not_depend_on_batches(spark, seed, batches, arrow):
    draw = random.Random(seed)
    rows = tab_rows(draw)
    got = run(spark, rows, TAB, "tab", keyed.TabState(10), cut(draw, len(rows), batches), arrow)
    last = {r.tab: r for r in got.orderBy("applied").collect()}
    assert {t: (r.kept, r.seen, r.ignored, r.resets, r.contexts) for t, r in last.items()} == plain_tabs(rows, 10)


def test_frames_as_after_navigation(spark):
    draw = random.Random(8)
    rows = [(t, s, k, f or 0, p, c) for t, s, k, f, p, c in tab_rows(draw, 4, 60)]
    known = windows.after_navigation(spark.createDataFrame(rows, TAB)).where("kind = 'context'").groupBy("tab", "frame").agg(F.max("seq").alias("seq"))
    want = {r.tab: sorted(r.x) for r in known.groupBy("tab").agg(F.collect_list("seq").alias("x")).collect()}
    got = run(spark, rows, TAB, "tab", keyed.TabState(10), cut(draw, len(rows), 3))
    assert {r.tab: r.contexts for r in got.orderBy("applied").collect() if r.applied == 59 and r.contexts} == want


def test_a_tab_stored_newest_first(spark):
    rows = [(1, s, "media", 0, f"f{s}", float(s)) for s in range(3000)]
    for arrow in (10_000, 100):
        got = run(spark, rows, TAB, "tab", keyed.TabState(10), [range(2999, -1, -1)], arrow).collect()
        assert [(r.applied, r.kept, r.seen, r.ignored) for r in got] == [(2999, 10, 3000, 0)]


# Windows

CHUNK = "job long, seq long, kind string, core_s double, core_e double, failed boolean, duration double"


def job_rows(draw, jobs=6, events=25):
    rows = []
    for job in range(jobs):
        duration = draw.choice([None, 60.0, 95.0])
        own = [("chunk", s := draw.choice([None, *range(0, 100, 5)]), None if s is None else s + draw.choice([1.0, 5.0, 20.0]), draw.random() < 0.3, duration) for _ in range(events)]
        if job % 2:
            own.insert(draw.randrange(events // 2, events), ("end", None, None, None, duration))
        rows += [(job, n, kind, None if s is None else float(s), e, failed, d) for n, (kind, s, e, failed, d) in enumerate(own)]
    return rows


def plain_windows(rows, size):
    out, state = [], {}
    for job, _, kind, s, e, failed, duration in sorted(rows, key=lambda r: r[:2]):
        windows_, told, over = state.setdefault(job, ({}, set(), []))

        def close(numbers):
            for b in numbers:
                told.add(b)
                out.append((job, b, *windows_.pop(b), True))

        if kind == "end":
            over.append(1)
            close(sorted(windows_))
            continue
        bucket = int(((s or 0) + 0.001) // size)
        close(sorted(b for b in windows_ if b < bucket))
        if bucket in told:
            out.append((job, bucket, 1, int(failed), False))
            continue
        n, bad = windows_.get(bucket, (0, 0))
        windows_[bucket] = (n + 1, bad + int(failed))
        end = min((bucket + 1) * size, duration or 1e9)
        if over or (e if e is not None else s or 0) + 0.001 >= end:
            close([bucket])
    return sorted(out)


@pytest.mark.parametrize("seed,batches,arrow", SPLITS)
def test_windows_are_told_once_whatever_the_batches(spark, seed, batches, arrow):
    draw = random.Random(seed)
    rows = job_rows(draw)
    got = sorted(map(tuple, run(spark, rows, CHUNK, "job", keyed.TranslationWindows(30.0), cut(draw, len(rows), batches), arrow).collect()))
    assert got == plain_windows(rows, 30.0)
    whole = [r[:2] for r in got if r[4]]
    assert len(whole) == len(set(whole))


def test_a_late_end_closes_what_is_open(spark):
    rows = [(1, 0, "chunk", 0.0, 5.0, False, None), (1, 1, "chunk", 1000.0, 1005.0, True, None), (1, 2, "chunk", 10.0, 15.0, False, None), (1, 3, "end", None, None, None, None)]
    for batches in ([[0, 1, 2, 3]], [[3], [2], [1], [0]], [[0], [1], [2], [3]]):
        got = run(spark, rows, CHUNK, "job", keyed.TranslationWindows(900.0), batches).collect()
        assert sorted(map(tuple, got)) == [(1, 0, 1, 0, False), (1, 0, 1, 0, True), (1, 1, 1, 1, True)]


def test_gaps_end_with_patience(spark):
    rows = [(1, s, "chunk", s * 10.0, s * 10.0 + 10, False, None) for s in range(8)] + [(1, 8, "end", None, None, None, None), (2, 0, "end", None, None, None, None), (2, 1, "end", None, None, None, None)]
    batches = [[0, 2, 3], [9], [10], [1, 2], [4, 5, 6, 7, 8]]
    got = sorted(map(tuple, run(spark, rows, CHUNK, "job", keyed.TranslationWindows(20.0, patience=1), batches, until=5).collect()))
    # The second chunk was given up, and is told when it comes; the repeated third one is not.
    assert got == [(1, 0, 1, 0, False), (1, 0, 1, 0, True), (1, 1, 2, 0, True), (1, 2, 2, 0, True), (1, 3, 2, 0, True)]


# Parts

PART = "media_id long, seq long, kind string, ord long, s double, e double, silent boolean, context boolean, speech_s double, speech_e double"


def part_rows(draw, media=4, parts=60):
    rows = []
    for m in range(media):
        at = 0.0
        for n in range(parts):
            length = draw.choice([1.0, 4.0, 9.5])
            quiet, known = draw.random() < 0.1, draw.random() < 0.8
            rows.append((m, n, "part", n, at, at + length, quiet, False, at + draw.choice([0.0, 0.9]) if known else None, at + length - draw.choice([0.0, 0.95]) if known else None))
            at += length + draw.choice([0.0, 0.0, 0.5, 1.5])
        rows.append((m, parts, "end", None, None, None, None, None, None, None))
    return rows


@pytest.mark.parametrize("seed,batches,arrow", SPLITS)
def test_parts_are_packed_as_in_a_batch(spark, seed, batches, arrow):
    draw = random.Random(seed)
    rows = part_rows(draw)
    told = folds.logical_chunks(spark.createDataFrame([r for r in rows if r[2] == "part"], PART).select("media_id", "ord", "s", "e", "silent", "speech_s", "speech_e"), 20.0, 2.0)
    want = {(r.media_id, r.chunk): (r.n, r["first"], r["last"]) for r in told.groupBy("media_id", "chunk").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last")).collect()}
    got = run(spark, rows, PART, "media_id", keyed.LogicalParts(20.0, 2.0), cut(draw, len(rows), batches), arrow).collect()
    assert len(got) == len(want)
    assert {(r.media_id, r.chunk): (r.parts, r["first"], r["last"]) for r in got} == want


def test_parts_with_context_stand_alone(spark):
    times = [(0, 5, False), (5, 9, True), (9, 12, False), (12, 15, False)]
    rows = [(1, n, "part", n, float(s), float(e), False, c, None, None) for n, (s, e, c) in enumerate(times)] + [(1, 4, "end", *[None] * 7)]
    got = run(spark, rows, PART, "media_id", keyed.LogicalParts(20.0), [[4, 2], [3, 1, 0]]).collect()
    assert sorted((r.chunk, r.s, r.e, r.parts, r["first"], r["last"]) for r in got) == [(0, 0.0, 5.0, 1, 0, 0), (1, 5.0, 9.0, 1, 1, 1), (2, 9.0, 15.0, 2, 2, 3)]
