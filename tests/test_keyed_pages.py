"""State of keyed streams: pages that keys share, what keys hold beyond them, and how often the state is called."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from test_streaming import CHUNK, TAB, plain_tabs, plain_windows, run

from cuetide.streaming import keyed


class State:
    """A value or map state in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.value, self.entries = calls, None, {}

    def __getattribute__(self, name):
        if name in ("get", "update", "getValue", "updateValue", "containsKey", "removeKey", "keys", "iterator"):
            self.calls.append(name)
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.entries[key] = value

    def containsKey(self, key):
        return key in self.entries

    def removeKey(self, key):
        del self.entries[tuple(key)]

    def keys(self):
        return iter(list(self.entries))

    def iterator(self):
        return iter(list(self.entries.items()))


def held(rule):
    """The rule with states in memory, their calls and the timers it has set."""
    calls, timers = [], []
    rule.init(SimpleNamespace(getValueState=lambda *_: State(calls), getMapState=lambda *_: State(calls), registerTimer=timers.append, deleteTimer=timers.remove))
    return calls, timers


def clock(now):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)


def frame(rows, schema):
    names = [part.split()[0] for part in schema.split(", ")]
    found = pd.DataFrame(rows, columns=names)
    return found.assign(**{keyed._PLACE: [hash((7, k)) & 0xFFFFFFFF for k in found[names[0]]]})


def fed(rule, frames, now=0):
    return [tuple(r) for out in rule.handleInputRows((0,), iter(frames), clock(now)) for r in out.itertuples(index=False, name=None)]


def test_keys_share_calls_to_the_state(spark):
    """Each row of each key called the state several times: 600 jobs of 4 rows were some 10,000 calls."""
    rows = [(job, s, "chunk", s * 400.0, s * 400.0 + 400, s == 2, None) for job in range(600) for s in range(3)] + [(job, 3, "end", None, None, False, None) for job in range(600)]
    rule = keyed.TranslationWindows(900.0)
    calls, _ = held(rule)
    got = []
    for part in (1, 0, 2):
        got += fed(rule, [frame([r for r in rows if r[1] % 3 == part], CHUNK)])
    assert sorted(got) == plain_windows(rows, 900.0)
    assert len(rule.pages.entries) >= 600 // 2 // keyed._PAGE
    assert len(calls) < 600


@pytest.mark.parametrize("size", [1, 17, 5000])
def test_pages_double_as_keys_come(size):
    draw = random.Random(size)
    rows = [(job, s, "chunk", draw.choice([0.0, 20.0, 40.0, 60.0]), None, draw.random() < 0.3, None) for job in range(150) for s in range(5)] + [(job, 5, "end", None, None, False, None) for job in range(150)]
    mixed = rows + draw.sample(rows, 50)
    draw.shuffle(mixed)
    rule = keyed.TranslationWindows(30.0)
    held(rule)
    got = fed(rule, [frame(mixed[k : k + size], CHUNK) for k in range(0, len(mixed), size)])
    assert sorted(got) == plain_windows(rows, 30.0)
    assert rule.keys == 150 and max(len(p[0]) for p in rule.pages.entries.values()) < 150


def test_more_than_a_page_holds():
    """Rows held back, windows told and candidates dropped go to maps of their own beyond a bound, and come from there."""
    rows = [(1, s, "chunk", s * 10.0, s * 10.0 + 10, False, None) for s in range(300)] + [(1, 300 + s, "chunk", s * 10.0, None, False, None) for s in range(0, 300, 7)]
    rows = [(job, n, *r[2:]) for job in (1, 2) for n, r in enumerate(rows)]
    rule = keyed.TranslationWindows(10.0)
    held(rule)
    got = fed(rule, [frame(rows[::-1][k : k + 50], CHUNK) for k in range(0, len(rows), 50)])
    assert sorted(got) == plain_windows(rows, 10.0)
    assert not rule.more.entries and len(rule.over.entries) == 2 * (300 - keyed._INLINE)


def test_a_navigation_forgets_what_is_beyond_the_page():
    rows = []
    for tab in (1, 2):
        rows += [(tab, s, "media", 0, f"f{s}", 1.0) for s in range(200)] + [(tab, 200, "navigate", 0, None, None)] * (tab == 1)
        rows += [(tab, len([r for r in rows if r[0] == tab]) + s, "media", 0, f"f{s}", 1.0) for s in range(200)]
    rule = keyed.TabState(10)
    held(rule)
    got = fed(rule, [frame(rows, TAB)])
    assert {r[0]: (r[2], r[3], r[4], r[5], r[6]) for r in got} == plain_tabs(rows, 10)
    assert rule.gone.entries


def test_gaps_of_many_keys_end_by_one_timer():
    rule = keyed.TranslationWindows(20.0, patience=5)
    _, timers = held(rule)
    chunk = lambda job, s: (job, s, "chunk", s * 10.0, s * 10.0 + 10, False, None)
    fed(rule, [frame([chunk(job, s) for job in range(40) for s in range(1, 90)], CHUNK)], now=100)
    fed(rule, [frame([chunk(job, 1) for job in range(40, 50)], CHUNK)], now=102)
    assert timers == [105]
    told = [tuple(r) for out in rule.handleExpiredTimer((0,), clock(105), None) for r in out.itertuples(index=False, name=None)]
    assert {r[0] for r in told} == set(range(40)) and timers == [105, 107] and not rule.more.entries
    assert fed(rule, [frame([chunk(3, 0), chunk(3, 1), chunk(41, 0)], CHUNK)], now=106) == [(3, 0, 1, 0, False), (41, 0, 2, 0, True)]
    list(rule.handleExpiredTimer((0,), clock(107), None))
    assert not rule.dues.entries and len(timers) == 2


def test_many_keys_in_a_stream(spark):
    rows = [(job, s, "chunk", s * 400.0, s * 400.0 + 400, s == 1, None) for job in range(400) for s in range(3)] + [(job, 3, "end", None, None, False, None) for job in range(400)]
    got = run(spark, rows, CHUNK, "job", keyed.TranslationWindows(900.0), [[i for i, r in enumerate(rows) if r[1] % 3 == part] for part in (1, 0, 2)])
    assert sorted(map(tuple, got.collect())) == plain_windows(rows, 900.0)


def test_tabs_share_calls_to_the_state():
    """Rows held back and candidates dropped were calls each: 300 tabs of 30 rows were some 40,000."""
    rows = [(tab, s, "navigate" if s == 20 else "media", 0, f"f{s * tab % 13}", float(s % 7)) for tab in range(300) for s in range(30)]
    rule = keyed.TabState(5)
    calls, _ = held(rule)
    got = {}
    for part in (1, 0, 2):
        got |= {r[0]: r for r in fed(rule, [frame([r for r in rows if r[1] % 3 == part], TAB)])}
    assert {t: (r[2], r[3], r[4], r[5], r[6]) for t, r in got.items()} == plain_tabs(rows, 5)
    assert len(calls) < 300


def test_windows_of_many_jobs_close_by_length_or_not_at_all():
    """As st06: 500 jobs' rows were some 8,000 calls to the state."""
    rows = [(job, s, "chunk", s * 400.0, s * 400.0 + 400, s == 1, 1600.0 if job % 3 == 1 else None) for job in range(500) for s in range(4)] + [(job, 4, "end", None, None, False, None) for job in range(0, 500, 3)]
    rule = keyed.TranslationWindows(900.0)
    calls, _ = held(rule)
    got = [r for part in (1, 0, 2) for r in fed(rule, [frame([r for r in rows if r[1] % 3 == part], CHUNK)])]
    assert sorted(got) == plain_windows(rows, 900.0) and len(calls) < 500


def test_late_chunks_of_many_jobs():
    """As st07: a chunk after its job's end, late or a window of its own; 500 jobs' rows were some 8,000 calls."""
    rows = []
    for job in range(500):
        order = [(0, "chunk"), (2, "chunk"), (3 if job % 2 else 6, "chunk"), (None, "end"), (1 if job % 5 else 4, "chunk")]
        rows += [(job, s, kind, None if n is None else n * 400.0, None if n is None else n * 400.0 + 400, job % 7 == 0, None) for s, (n, kind) in enumerate(order)]
    rule = keyed.TranslationWindows(900.0)
    calls, _ = held(rule)
    got = [r for part in (1, 0, 2) for r in fed(rule, [frame([r for r in rows if r[1] % 3 == part], CHUNK)])]
    assert sorted(got) == plain_windows(rows, 900.0) and len(calls) < 500
    assert {r[4] for r in got} == {True, False}
