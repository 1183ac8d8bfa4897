"""Ordered folds that no window can express, because a row is compared with what earlier rows have become.

Each works on the rows of one media, in order, which is what the fold is defined on. The per-row step is a few lines that
keep the open row alone; Spark partitions, sorts and spills. Rows stream through a task and finished ones leave it in
batches, so a media of any length takes the memory of a batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.params import P
from cuetide.session import ship

_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}


#: Rows that a task gathers before it sends them on.
_SENT = 5000


def fold(df: DataFrame, key: str, order: list[str], schema: str, step: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """step gets a group's rows one by one, in order, and yields rows of schema, of which the first column is the key. Rows
    arrive sorted by key; neither side of a step is held whole."""
    ship(df.sparkSession)
    kind = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in kind.fields])

    def table(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        found: list[tuple] = []
        for _, group in itertools.groupby(rows, lambda row: row[key]):
            for out in step(group):
                found.append(out)
                if len(found) >= _SENT:
                    yield table(found)
                    found = []
        if found:
            yield table(found)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)


def merge_duplicates(df: DataFrame, gap: float = P.duplicate_gap, overlap: float = P.duplicate_overlap) -> DataFrame:
    """Neighbours of one text become one where they touch or overlap by half of the shorter; the comparison is with what
    the earlier one has grown to. (media_id, ord, s, e, text), ord of the first."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        last: list | None = None
        for r in rows:
            if last is not None and last[4] == r["text"] and r["text"]:
                apart = r["s"] - last[3]
                shared = min(last[3], r["e"]) - max(last[2], r["s"])
                shorter = min(last[3] - last[2], r["e"] - r["s"])
                if overlap <= apart <= gap or (shared > 0 and shorter > 0 and shared / shorter >= 0.5):
                    last[2], last[3] = min(last[2], r["s"]), max(last[3], r["e"])
                    continue
            if last is not None:
                yield tuple(last)
            last = [r["media_id"], r["ord"], r["s"], r["e"], r["text"]]
        if last is not None:
            yield tuple(last)

    return fold(df.select("media_id", "ord", "s", "e", "text"), "media_id", ["s", "e", "ord"], "media_id long, ord long, s double, e double, text string", step)


def sentences(df: DataFrame, chars: int = 32, silence: float = 0.8, seconds: float = 7.0) -> DataFrame:
    """Words to sentences: a new one before a word if the text is long enough, a pause precedes, or it would last too
    long. (media_id, idx, s, e, text, words)."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        now: list[dict] = []  # bounded by chars: a word that comes to a long enough text starts the next
        number = 0

        def closed() -> tuple:
            joint = "" if any("㐀" <= c <= "鿿" for w in now for c in w["text"]) else " "
            return now[0]["media_id"], number, now[0]["s"], now[-1]["e"], joint.join(w["text"] for w in now), len(now)

        for r in rows:
            if now and (len(closed()[4]) >= chars or r["s"] - now[-1]["e"] >= silence or r["e"] - now[0]["s"] >= seconds):
                yield closed()
                number, now = number + 1, []
            now.append(r)
        if now:
            yield closed()

    return fold(df.select("media_id", "ord", "s", "e", "text"), "media_id", ["s", "e", "ord"], "media_id long, idx long, s double, e double, text string, words long", step)


def media_score(visible: Column, playing: Column, is_video: Column, width: Column, height: Column, ready: Column, has_duration: Column, has_source: Column) -> Column:
    """How much a medium of a page is the one that is watched. The points of each sign."""
    points = lambda sign, n: F.when(sign, n).otherwise(0)
    n = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    return points(visible, 100_000_000) + points(playing, 500_000) + points(is_video, 1_000_000) + n(width) * n(height) + n(ready) * 1_000 + points(has_duration, 10_000) + points(has_source, 5_000)


def primary_medium(df: DataFrame) -> DataFrame:
    """df: media_id (a page), at, ord (a medium of it), score, visible, playing, a row for each medium seen at a time. The
    medium that is watched at each time: the one before stays while it is visible or playing, unless one that is both has a
    higher score; else the highest score wins, then the lowest ord. (media_id, at, ord)."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        last = None
        for at, seen in itertools.groupby(rows, lambda r: r["at"]):
            best = better = stays = page = None
            seen = sorted(seen, key=lambda r: (-r["score"], r["ord"]))  # the media of one page at one time
            for r in seen:
                page = r["media_id"]
                best = r if best is None else best
                stays = r if r["ord"] == last and (r["visible"] or r["playing"]) else stays
                better = r if better is None and r["visible"] and r["playing"] and r["ord"] != last else better
            chosen = best if stays is None else better if better is not None and better["score"] > stays["score"] else stays
            last = chosen["ord"]
            yield page, at, last

    return fold(df.select("media_id", "at", "ord", "score", "visible", "playing"), "media_id", ["at", "ord"], "media_id long, at long, ord long", step)


def clip_windows(df: DataFrame, seconds: float = P.pack_seconds) -> DataFrame:
    """Speech intervals to windows that start with one and last at most so long, unless one interval is longer.
    (media_id, idx, s, e, members)."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        now: list | None = None
        for r in rows:
            if now is not None and not (r["e"] - now[2] > seconds and now[3] > now[2]):
                now[3] = max(now[3], r["e"])
                now[4] += 1
                continue
            if now is not None:
                yield tuple(now)
            now = [r["media_id"], 0 if now is None else now[1] + 1, r["s"], r["e"], 1]
        if now is not None:
            yield tuple(now)

    return fold(df.where("e > s").select("media_id", "ord", "s", "e"), "media_id", ["s", "e", "ord"], "media_id long, idx long, s double, e double, members long", step)


def pack_speech(df: DataFrame, seconds: float = P.pack_seconds) -> DataFrame:
    """Speech collected in bins of at most so many seconds, in order; long intervals are cut. A row per part:
    (media_id, bin, src_s, src_e, out_s, out_e), which is the time map of the bins."""
    rounded = lambda x: int(x * 1000 + 0.5) / 1000

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        number, used = 0, 0.0
        for r in rows:
            start = r["s"]
            while start < r["e"] - 0.001:
                end = r["e"] if r["e"] - start <= seconds + 0.001 else start + seconds
                length = rounded(end - start)
                if used and used + length > seconds + 0.001:
                    number, used = number + 1, 0.0
                if length > 0:
                    yield r["media_id"], number, rounded(start), rounded(end), rounded(used), rounded(used + length)
                    used = rounded(used + length)
                start = end

    return fold(df.where("e > s and s >= 0").select("media_id", "ord", "s", "e"), "media_id", ["s", "e", "ord"], "media_id long, bin long, src_s double, src_e double, out_s double, out_e double", step)


def group_segments(df: DataFrame, seconds: float = P.group_seconds, most: int = P.group_count) -> DataFrame:
    """Playlist segments to extraction groups: by length, number, and at breaks. df: media_id, ord, s, e, starts_new.
    (media_id, ord, grp)."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        number, count, start, end = 0, 0, 0.0, 0.0
        for r in rows:
            start = start if count else r["s"]
            if count and (r["starts_new"] or end - start + (r["e"] - r["s"]) > seconds or count >= most):
                number, count, start = number + 1, 0, r["s"]
            yield r["media_id"], r["ord"], number
            count, end = count + 1, r["e"]

    return fold(df.select("media_id", "ord", "s", "e", "starts_new"), "media_id", ["ord"], "media_id long, ord long, grp long", step)


def logical_chunks(df: DataFrame, seconds: float, silence: float = P.vad_split_silence) -> DataFrame:
    """Audio parts to logical chunks: closed by a part known to be silent, by a pause between the speech of two parts, and
    before they grow too long. df: media_id, ord, s, e, silent, speech_s, speech_e (null: unknown). (media_id, ord, chunk);
    silent parts belong to none."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        number, start, end, spoke = 0, None, 0.0, None
        for r in rows:
            if r["silent"]:
                if start is not None:
                    number, start, spoke = number + 1, None, None
                continue
            pause = spoke is not None and r["speech_s"] is not None and r["speech_s"] - spoke >= silence
            if start is not None and (pause or end - start + (r["e"] - r["s"]) > seconds):
                number, start, spoke = number + 1, None, None
            start = r["s"] if start is None else start
            end = r["e"]
            spoke = r["speech_e"] if r["speech_e"] is not None else spoke
            yield r["media_id"], r["ord"], number
            if end - start >= seconds:
                number, start, spoke = number + 1, None, None

    return fold(df, "media_id", ["s", "ord"], "media_id long, ord long, chunk long", step)
