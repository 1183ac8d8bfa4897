"""SimHash, components, substring removal and decontamination against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cuetide.llm import common, components, decontam, queries, simhash, substring

few = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
DOCS = "doc_id long, text string"


def united(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@few
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = united(31, pairs)
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in components.connected_components(edges).collect()} == {0}


def brute_components(texts):
    ids = sorted(texts)
    prints = np.array([simhash.fingerprint(texts[i]) for i in ids], np.uint64)
    pairs = [(i, int(j)) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    return {ids[i]: (f"{int(prints[i]):016x}", ids[c]) for i, c in enumerate(united(len(ids), pairs))}


def test_fingerprint_by_definition(spark):
    from pyspark.sql import functions as F

    text = "A b\tc d a b c"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [r[0] % (1 << 64) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == want and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_op4(spark, sf, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf).collect()}
    assert got == brute_components(texts)


def test_near_copies_link_and_the_first_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = {i: base.replace("w200", f"x{i}") if i else base for i in range(12)} | {20: None, 21: "", 22: "   ", 30: "other text here"}
    frame = spark.createDataFrame(sorted(texts.items()), DOCS)
    want = brute_components(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == {k: c for k, (_, c) in want.items()} and got[21] == got[22] == 20
    kept = {r.doc_id for r in simhash.keep_first(frame).collect()}
    assert kept == {k for k, (_, c) in want.items() if k == c}
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


@few
@given(st.lists(st.integers(0, 2**64 - 1), max_size=6), st.lists(st.sets(st.integers(0, 63), max_size=4), min_size=6, max_size=6))
def test_links_lose_nothing(spark, bases, flips):
    prints = sorted({b ^ sum(1 << x for x in f) for b in bases for f in flips})
    rows = [(p - (1 << 64) if p >= 1 << 63 else p, i) for i, p in enumerate(prints)]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame(rows, "fingerprint long, rep long")).collect()}
    assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df)
        return common.stored(df, name)

    monkeypatch.setattr(simhash, "stored", kept)
    monkeypatch.setattr(components, "stored", kept)
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(i, base.replace("w200", f"x{i}") if i % 3 else f"other {i}") for i in range(30)]
    frame = common.stored(spark.createDataFrame(texts, DOCS), "few-texts")
    plans += [simhash.keep_first(frame), simhash.near_duplicates(frame)]
    assert any("Join" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]


def brute_removal(texts, length):
    first = {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                keep[k : k + length] = [False] * length
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_op6(spark, sf, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring(spark, sf).collect()}
    assert got == brute_removal(texts, 50)


@pytest.mark.parametrize("period", sorted(substring.COVERS))
def test_covers(period):
    cover = substring.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@few
@given(st.lists(st.text("ab ", max_size=60), max_size=8))
def test_repeats_of_short_passages(spark, rows):
    texts = dict(enumerate(rows))
    frame = spark.createDataFrame(list(texts.items()), DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring.remove_repeats(frame, 10).collect()}
    assert got == brute_removal(texts, 10)


def test_substring_edge_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (None, passage), (2, "x " + passage + " y"), (3, None), (4, ""), (5, passage), (5, passage)]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(0, 60, 0), (1, 60, 0), (2, 62, 60), (3, 0, 0), (4, 0, 0), (5, 60, 60), (5, 60, 60)]
    assert substring.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def brute_hits(texts, items, n=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, who = word.findall(low(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    who |= own
        out[d] = (len(w), len(hit), len(who), decontam.items_digest(list(who)), bool(hit))
    return out


def test_op9(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op9_decontamination(spark, sf).collect()}
    assert got == brute_hits(texts, items)


def test_decontamination_in_blocks_and_edge_rows(spark):
    items = [(1, "One two, three four five six seven eight nine ten ELEVEN"), (2, "short item"), (3, None), (4, "!!"), (5, "one two three four five six seven eight nine ten eleven"), (6, "é1 ß")]
    texts = {1: "x one two three four five six seven eight nine ten y", 2: None, 3: "", 4: "a Short-Item and é1 ß", 5: "one two three"}
    docs, bench = spark.createDataFrame(list(texts.items()), DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    for block in (1, 3, 1000):
        hits = decontam.find_hits(docs, bench, block_windows=block)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(hits).collect()} == want
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {2, 3, 5}
    assert {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}[1] == "x   y"
    assert decontam.report(decontam.find_hits(docs, bench.limit(0))).where("contaminated").count() == 0
