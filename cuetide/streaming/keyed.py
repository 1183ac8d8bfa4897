"""Keyed streams whose result does not depend on how their input is cut into batches.

A row carries its key and `seq`, the key's own count of its rows: 0, 1, 2 and so on, as a log, a message counter or a chunk
index gives it. Rows are applied in that order, whatever batch or Arrow batch brings them: the next one at once, one that
comes too early after those before it, from a map in the state store until then, and one that has been applied is left
out, so a source that repeats itself changes nothing. What comes out is a function of the rows alone.

With `patience`, the milliseconds of the clock that a gap may stay, what is held is applied without the missing rows after
that time; if one comes yet, it is told as late and not applied. Without it a gap waits.

State is typed and in RocksDB. A call to it takes about as long as a hundred rows, so keys share it: they are dealt to blocks,
the grouping keys, and within a block to pages of some keys each, which double in number as the block grows. A page is read
and written once for the rows that an Arrow batch has of its keys. It holds of each key what the rule keeps, and the rows held
back, up to a bound, as JSON, since typed ones in it are turned over cell by cell; what a key has beyond it is in maps, an entry for each. A task holds one Arrow batch and one page.

`seq` and the key must not be null; rows without them are left out and should be counted before.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuetide.params import P
from cuetide.session import ship

#: Rows that a key gathers before it sends them on.
_SENT = 5000
#: Fixed values, for a checkpoint knows them: blocks of keys, and keys that a page has on average before pages double.
_BLOCKS, _PAGE = 4096, 16
#: Rows held back, and items of a rule's sets, that a key has in its page.
_INLINE = 64
#: Columns beside the caller's: a key's block, and its place within. Spark would rename those that begin with an underscore.
_BLOCK, _PLACE = "block_", "place_"


_KINDS = {"long": (T.LongType(), int), "int": (T.IntegerType(), int), "double": (T.DoubleType(), float), "string": (T.StringType(), str), "boolean": (T.BooleanType(), bool)}


def _struct(ddl: str) -> T.StructType:
    """A schema of plain types, made without a session: a processor is set up in a process that has none."""
    return T.StructType([T.StructField(name, _KINDS[kind][0]) for name, kind in (part.split() for part in ddl.split(", "))])


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _casts(ddl: str) -> list[Callable[[Any], Any]]:
    """What makes pandas cells Python values of the schema's types; missing ones are None. pandas has whole numbers with
    missing ones among them as fractions, which a state would take for missing."""

    def cast(to: Callable[[Any], Any]) -> Callable[[Any], Any]:
        return lambda value: None if value is None or value != value else to(value)

    return [cast(_KINDS[part.split()[1]][1]) for part in ddl.split(", ")]


def _array(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)


class InOrder(StatefulProcessor):
    """Rows of a key one by one in the order of seq. A rule has the columns it reads, `payload`, and its output, `out`, as
    DDL; `kept` is the type of what it keeps of a key, which `unpacked` makes from a row of it, or anew, and `packed` makes
    such a row again; `start` makes its maps, `apply` takes a row."""

    payload: str
    out: str

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names, self.out_names, self.casts = _names(self.payload), _names(self.out), _casts(self.payload)
        self.key = self.out_names[0]
        kind = self.out.split(", ")[0].split()[1]
        self.own, self.handle = _KINDS[kind][1], handle
        skipped = _struct("first long, last long")
        entry = T.StructType([*_struct(f"key {kind}, place long, next long, beyond long, due long, held string").fields, T.StructField("skipped", _array(skipped)), T.StructField("own", self.kept())])
        self.block = handle.getValueState("block", _struct("depth int, keys long, timer long"))
        self.pages = handle.getMapState("pages", _struct("page long"), T.StructType([T.StructField("keys", _array(entry))]))
        self.more = handle.getMapState("more", _struct(f"key {kind}, seq long"), _struct(self.payload))
        self.dues = handle.getMapState("dues", _struct(f"due long, key {kind}"), _struct("place long"))
        self.start(handle, kind)

    def kept(self) -> T.StructType:
        raise NotImplementedError

    def start(self, handle: StatefulProcessorHandle, kind: str) -> None: ...

    def unpacked(self, row: tuple | None) -> SimpleNamespace:
        raise NotImplementedError

    def packed(self, own: SimpleNamespace) -> tuple:
        raise NotImplementedError

    def apply(self, key: Any, seq: int, row: dict, own: SimpleNamespace) -> Iterator[tuple]:
        raise NotImplementedError

    def late(self, key: Any, seq: int, row: dict) -> Iterator[tuple]:
        """What tells of a row that came after its gap was given up."""
        return iter(())

    def told(self, key: Any, following: int, own: SimpleNamespace) -> Iterator[tuple]:
        """What tells of a key after its rows of an Arrow batch; following is the next row's number."""
        return iter(())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self._sent(self._taken(rows, timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._sent(self._expired(timerValues))

    def _sent(self, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in found:
            out.append(row)
            if len(out) >= _SENT:
                yield pd.DataFrame(out, columns=self.out_names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=self.out_names)

    # Blocks and pages

    def _opened(self) -> None:
        self.depth, self.keys, self.timer = self.block.get() or (0, 0, None)

    def _closed(self) -> None:
        self.block.update((self.depth, self.keys, self.timer))

    def _new(self, key: Any, place: int) -> SimpleNamespace:
        self.keys += 1
        return SimpleNamespace(key=key, place=place, next=0, beyond=0, due=None, held={}, skipped=[], own=self.unpacked(None))

    def _page(self, number: int) -> list[tuple]:
        found = self.pages.getValue((number,)) if self.keys else None
        return found[0] if found is not None else []

    def _read(self, number: int) -> dict[Any, SimpleNamespace]:
        return {
            key: SimpleNamespace(key=key, place=place, next=following, beyond=beyond, due=due, held={seq: tuple(values) for seq, *values in json.loads(held)}, skipped=[tuple(x) for x in skipped], own=self.unpacked(own))
            for key, place, following, beyond, due, held, skipped, own in self._page(number)
        }

    def _write(self, number: int, entries: dict[Any, SimpleNamespace]) -> None:
        rows = [(e.key, e.place, e.next, e.beyond, e.due, json.dumps([(seq, *values) for seq, values in e.held.items()]) if e.held else "[]", e.skipped, self.packed(e.own)) for e in entries.values()]
        self.pages.updateValue((number,), (rows,))

    def _double(self) -> None:
        """Each page gives the keys whose place has the next bit to a page of their own."""
        bit = 1 << self.depth
        for number in range(bit):
            entries = self._read(number)
            if moved := {k: e for k, e in entries.items() if e.place & bit}:
                self._write(number + bit, moved)
                self._write(number, {k: e for k, e in entries.items() if k not in moved})
        self.depth += 1

    # Rows

    def _taken(self, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[tuple]:
        self._opened()
        for frame in rows:
            if not self.keys:
                while frame[self.key].nunique() > _PAGE << self.depth:
                    self.depth += 1
            mask, pages = (1 << self.depth) - 1, {}
            for place, key, *found in frame[[_PLACE, self.key, "seq", *self.names]].itertuples(index=False, name=None):
                pages.setdefault(place & mask, {}).setdefault(key, (place, []))[1].append(found)
            for number, keys in pages.items():
                entries = self._read(number)
                for key, (place, found) in keys.items():
                    key = self.own(key)
                    entry = entries.get(key) or entries.setdefault(key, self._new(key, int(place)))
                    yield from self._applied(entry, found)
                    self._watched(entry, timerValues)
                self._write(number, entries)
            while self.keys > _PAGE << self.depth:
                self._double()
        self._closed()

    def _applied(self, entry: SimpleNamespace, rows: list[list]) -> Iterator[tuple]:
        rows.sort(key=lambda found: found[0])
        for seq, *cells in rows:
            seq, values = int(seq), tuple([cast(v) for cast, v in zip(self.casts, cells, strict=True)])
            if seq < entry.next:
                if self.patience is not None and any(first <= seq <= last for first, last in entry.skipped):
                    yield from self.late(entry.key, seq, dict(zip(self.names, values, strict=True)))
            elif seq == entry.next:
                yield from self.apply(entry.key, seq, dict(zip(self.names, values, strict=True)), entry.own)
                entry.next += 1
                yield from self._followers(entry)
            elif seq not in entry.held and not (entry.beyond and self.more.containsKey((entry.key, seq))):
                if len(entry.held) < _INLINE:
                    entry.held[seq] = values
                else:
                    self.more.updateValue((entry.key, seq), values)
                    entry.beyond += 1
        yield from self.told(entry.key, entry.next, entry.own)

    def _followers(self, entry: SimpleNamespace) -> Iterator[tuple]:
        """Rows held back whose turn has come."""
        while entry.held or entry.beyond:
            values = entry.held.pop(entry.next, None)
            if values is None:
                at = (entry.key, entry.next)
                if not entry.beyond or not self.more.containsKey(at):
                    return
                values = self.more.getValue(at)
                self.more.removeKey(at)
                entry.beyond -= 1
            yield from self.apply(entry.key, entry.next, dict(zip(self.names, values, strict=True)), entry.own)
            entry.next += 1

    # Gaps that are given up

    def _watched(self, entry: SimpleNamespace, timerValues: Any) -> None:
        """Each key with a gap has a time at which it ends; a block has one timer, at its first such time or before."""
        if self.patience is None:
            return
        waits = bool(entry.held or entry.beyond)
        if not waits and entry.due is not None:
            self.dues.removeKey((entry.due, entry.key))
            entry.due = None
        elif waits and entry.due is None:
            entry.due = timerValues.getCurrentProcessingTimeInMs() + self.patience
            self.dues.updateValue((entry.due, entry.key), (entry.place,))
            self._timed(entry.due)

    def _timed(self, due: int) -> None:
        if self.timer is None:
            self.handle.registerTimer(due)
            self.timer = due

    def _expired(self, timerValues: Any) -> Iterator[tuple]:
        self._opened()
        self.timer, now = None, timerValues.getCurrentProcessingTimeInMs()
        waiting = [(*key, place[0]) for key, place in self.dues.iterator()]
        if later := [due for due, _, _ in waiting if due > now]:
            self._timed(min(later))
        for due, key, place in waiting:
            if due > now:
                continue
            self.dues.removeKey((due, key))
            number = place & ((1 << self.depth) - 1)
            entries = self._read(number)
            entry = entries[key]
            entry.due = None
            yield from self._without_missing(entry)
            self._watched(entry, timerValues)
            self._write(number, entries)
        self._closed()

    def _without_missing(self, entry: SimpleNamespace) -> Iterator[tuple]:
        if entry.held or entry.beyond:
            far = (seq for key, seq in self.more.keys() if key == entry.key) if entry.beyond else ()  # noqa: SIM118  a state's keys
            resumed = min(itertools.chain(entry.held, far))
            entry.skipped.append((entry.next, resumed - 1))
            entry.next = resumed
            yield from self._followers(entry)
        yield from self.told(entry.key, entry.next, entry.own)


def in_order(stream: DataFrame, key: str, rule: InOrder, mode: str = "append") -> DataFrame:
    """The rule's output over a stream of key, seq and the rule's columns. The key is the output's first column."""
    ship(stream.sparkSession)
    dealt = F.xxhash64(F.col(key))
    rows = stream.where(F.col(key).isNotNull() & F.col("seq").isNotNull()).select(F.pmod(dealt, F.lit(_BLOCKS)).cast("long").alias(_BLOCK), F.floor(F.shiftrightunsigned(dealt, 1) / _BLOCKS).cast("long").alias(_PLACE), F.col(key).alias(_names(rule.out)[0]), F.col("seq").cast("long").alias("seq"), *_names(rule.payload))
    clock = "none" if rule.patience is None else "processingTime"
    return rows.groupBy(_BLOCK).transformWithStateInPandas(rule, rule.out, mode, clock)


class TranslationWindows(InOrder):
    """Chunks gathered into windows of media time by the start of their core. A window is told once, with complete true, as
    soon as it is closed: by a chunk of a later window, by a chunk that reaches its target end (the window's, or the
    media's if that is less), or by the row of kind `end`. A chunk for a window that was told comes out as a row of its own
    with complete false. After the end, a chunk of a window not yet told is a window of its own. `seq` counts a job's
    rows of both kinds in the order in which they happened."""

    payload = "kind string, core_s double, core_e double, failed boolean, duration double"
    out = "job long, bucket long, chunks long, failed long, complete boolean"

    def __init__(self, size: float = P.translation_seconds, patience: int | None = None):
        super().__init__(patience)
        self.size = size

    def kept(self) -> T.StructType:
        # Rule one leaves the newest window open, and older ones only if they came after it.
        return T.StructType([T.StructField("open", _array(_struct("bucket long, chunks long, failed long"))), T.StructField("over", _array(T.LongType())), *_struct("beyond long, ended boolean").fields])

    def start(self, handle: StatefulProcessorHandle, kind: str) -> None:
        self.over = handle.getMapState("over", _struct(f"key {kind}, bucket long"), _struct("chunks long"))

    def unpacked(self, row: tuple | None) -> SimpleNamespace:
        opened, over, beyond, ended = row or ((), (), 0, False)
        return SimpleNamespace(open={b: (chunks, failed) for b, chunks, failed in opened}, over=set(over), beyond=beyond, ended=ended)

    def packed(self, own: SimpleNamespace) -> tuple:
        return [(b, *counts) for b, counts in own.open.items()], list(own.over), own.beyond, own.ended

    def _close(self, key: Any, buckets: list[int], own: SimpleNamespace) -> Iterator[tuple]:
        for b in sorted(buckets):
            chunks, failed = own.open.pop(b)
            if len(own.over) < _INLINE:
                own.over.add(b)
            else:
                self.over.updateValue((key, b), (chunks,))
                own.beyond += 1
            yield key, b, chunks, failed, True

    def apply(self, key: Any, seq: int, row: dict, own: SimpleNamespace) -> Iterator[tuple]:
        if row["kind"] == "end":
            own.ended = True
            yield from self._close(key, list(own.open), own)
            return
        start = row["core_s"] or 0.0
        bucket = max(0, int((max(0.0, start) + 0.001) // self.size))
        yield from self._close(key, [b for b in own.open if b < bucket], own)
        if bucket in own.over or (own.beyond and self.over.containsKey((key, bucket))):
            yield from self.late(key, seq, row)
            return
        chunks, failed = own.open.get(bucket, (0, 0))
        own.open[bucket] = (chunks + 1, failed + int(bool(row["failed"])))
        target = (bucket + 1) * self.size
        target = min(target, row["duration"]) if row["duration"] else target
        if own.ended or (row["core_e"] if row["core_e"] is not None else start) + 0.001 >= target:
            yield from self._close(key, [bucket], own)

    def late(self, key: Any, seq: int, row: dict) -> Iterator[tuple]:
        if row["kind"] != "end":
            yield key, max(0, int((max(0.0, row["core_s"] or 0.0) + 0.001) // self.size)), 1, int(bool(row["failed"])), False


class TabState(InOrder):
    """What a browser tab has shown. Rows of kind `media` have a fingerprint and a score: the best `most` are kept, and one
    that was dropped stays known, so that it is ignored when it comes again. Rows of kind `context` say what a frame is
    about; a frame's latest stays. `navigate` of frame 0 forgets the tab, that of another frame what this frame told, but no
    candidates. A row with the tab's counts comes out for each Arrow batch that applied something; that with the greatest
    `applied` is the tab's state."""

    payload = "kind string, frame int, fingerprint string, score double"
    out = "tab long, applied long, kept long, seen long, ignored long, resets long, contexts array<long>"

    def __init__(self, most: int = P.candidates_kept, patience: int | None = None):
        super().__init__(patience)
        self.most = most

    def kept(self) -> T.StructType:
        best, frames = _struct("fingerprint string, score double, seq long"), _struct("frame int, seq long")
        return T.StructType([T.StructField("best", _array(best)), T.StructField("frames", _array(frames)), T.StructField("gone", _array(T.StringType())), *_struct("beyond long, ignored long, resets long, told long").fields])

    def start(self, handle: StatefulProcessorHandle, kind: str) -> None:
        self.gone = handle.getMapState("gone", _struct(f"key {kind}, fingerprint string"), _struct("seq long"))

    def unpacked(self, row: tuple | None) -> SimpleNamespace:
        best, frames, gone, beyond, ignored, resets, told = row or ((), (), (), 0, 0, 0, 0)
        return SimpleNamespace(best={f: (score, seq) for f, score, seq in best}, frames={frame: seq for frame, seq in frames}, gone=set(gone), beyond=beyond, ignored=ignored, resets=resets, told=told)

    def packed(self, own: SimpleNamespace) -> tuple:
        return [(f, *x) for f, x in own.best.items()], list(own.frames.items()), list(own.gone), own.beyond, own.ignored, own.resets, own.told

    def apply(self, key: Any, seq: int, row: dict, own: SimpleNamespace) -> Iterator[tuple]:
        kind, frame, fingerprint = row["kind"], row["frame"] or 0, row["fingerprint"]
        if kind == "navigate" and frame == 0:
            if own.beyond:
                for k in [k for k in self.gone.keys() if k[0] == key]:  # noqa: SIM118  a state's keys
                    self.gone.removeKey(tuple(k))
            own.best, own.frames, own.gone, own.beyond, own.ignored, own.resets = {}, {}, set(), 0, 0, own.resets + 1
        elif kind == "navigate":
            own.frames.pop(frame, None)
        elif kind == "context":
            own.frames[frame] = seq
        elif fingerprint is not None and (fingerprint in own.gone or (own.beyond and self.gone.containsKey((key, fingerprint)))):
            own.ignored += 1
        elif fingerprint is not None:
            own.best[fingerprint] = (row["score"] or 0.0, seq)
            if len(own.best) > self.most:
                worst = min(own.best, key=lambda f: (*own.best[f], f))
                del own.best[worst]
                if len(own.gone) < _INLINE:
                    own.gone.add(worst)
                else:
                    self.gone.updateValue((key, worst), (seq,))
                    own.beyond += 1
        return iter(())

    def told(self, key: Any, following: int, own: SimpleNamespace) -> Iterator[tuple]:
        if following > own.told:
            own.told = following
            gone = len(own.gone) + own.beyond
            yield key, following - 1, len(own.best), len(own.best) + gone, own.ignored, own.resets, sorted(own.frames.values())


class LogicalParts(InOrder):
    """Audio parts packed into logical chunks, as operators.folds.logical_chunks does over a finished table: closed by a
    part known to be silent, by a pause between the speech of two parts, and before they grow too long; the row of kind
    `end` closes the last. A part that carries overlap of its neighbours which is not at a boundary of logical chunks
    (`context` true) is a chunk of its own. A chunk comes out once, when it is closed, with its times and its parts."""

    payload = "kind string, ord long, s double, e double, silent boolean, context boolean, speech_s double, speech_e double"
    out = "media_id long, chunk long, s double, e double, parts long, first long, last long"

    def __init__(self, seconds: float, silence: float = P.vad_split_silence, patience: int | None = None):
        super().__init__(patience)
        self.seconds, self.silence = seconds, silence

    def kept(self) -> T.StructType:
        return _struct("chunk long, parts long, s double, e double, first long, last long, spoke double")

    def unpacked(self, row: tuple | None) -> SimpleNamespace:
        chunk, parts, s, e, first, last, spoke = row or (0, 0, 0.0, 0.0, 0, 0, None)
        return SimpleNamespace(chunk=chunk, parts=parts, s=s, e=e, first=first, last=last, spoke=spoke)

    def packed(self, own: SimpleNamespace) -> tuple:
        return own.chunk, own.parts, own.s, own.e, own.first, own.last, own.spoke

    def _close(self, key: Any, own: SimpleNamespace) -> Iterator[tuple]:
        if own.parts:
            yield key, own.chunk, own.s, own.e, own.parts, own.first, own.last
            own.chunk, own.parts, own.spoke = own.chunk + 1, 0, None

    def apply(self, key: Any, seq: int, row: dict, own: SimpleNamespace) -> Iterator[tuple]:
        if row["kind"] == "end" or row["silent"]:
            yield from self._close(key, own)
            return
        pause = own.spoke is not None and row["speech_s"] is not None and row["speech_s"] - own.spoke >= self.silence
        if row["context"] or pause or (own.parts and own.e - own.s + (row["e"] - row["s"]) > self.seconds):
            yield from self._close(key, own)
        if not own.parts:
            own.s, own.first = row["s"], row["ord"]
        own.parts, own.e, own.last = own.parts + 1, row["e"], row["ord"]
        own.spoke = row["speech_e"] if row["speech_e"] is not None else own.spoke
        if row["context"] or own.e - own.s >= self.seconds:
            yield from self._close(key, own)
