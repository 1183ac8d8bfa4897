"""Sources and operators on hostile input, and against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuetide.operators import assets, attempts, candidates, folds, jobs, ranges, retention, services
from cuetide.sources import events, pages


# Structured media and pages


def test_structured_media_outlives_any_payload(spark):
    entry = {"url": "https://h/a.mp3", "mimeType": "audio/mpeg"}
    texts = [json.dumps(entry | more) for more in ({"contentLength": "1e999"}, {"contentLength": 1e308}, {"contentLength": "9" * 23}, {"contentLength": "9007199254740993"}, {"bitrate": "nan"}, {"width": True}, {"size": [1]}, {"size": -5})]
    texts += ['{"url": "https://h/a.mp3", "mimeType": "audio/mpeg", "contentLength": 1e999}', "[" * 200_000, '{"a":' * 100_000, "", None, "null", '"x"', "{}", '{"url": 5}', "﻿{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, payload string")
    got = {r.id: r for r in events.structured_media(rows, "id").collect()}
    assert set(got) == set(range(9))
    assert [got[i]["size"] for i in range(9)] == [None, None, None, 9007199254740993, None, None, None, -5, None]


def test_pages_with_equal_ends_keep_their_urls(spark):
    middle = lambda i: "x" * 600 + f'<a href="https://h.example/{i}">' + "y" * 600
    rows = [(i, f"https://p{i}.example/", middle(i)) for i in range(3)] + [(7, "https://p7.example/", middle(1)), (8, "http://p8.example/", '<a href="//h.example/z">'), (8, "http://p8.example/", '<a href="//h.example/z">'), (9, "https://p9.example/", "z" * 3_000_000 + ' "https://h.example/far"'), (10, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.target) for r in pages.markup_urls(docs).collect())
    assert got == [(0, "https://h.example/0"), (1, "https://h.example/1"), (2, "https://h.example/2"), (7, "https://h.example/1"), (8, "http://h.example/z"), (9, "https://h.example/far")]
    assert pages.markup_urls(docs, most_chars=2_000_000).count() == 5
    assert [tuple(r) for r in pages.left_out(docs, 2_000_000).collect()] == [(9, 3_000_024)]


# Ranges

RESPONSE = "resource long, offset long, length long, status int, content_range string, body binary"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_files_of_random_ranges(spark, seed):
    draw, rows, want = random.Random(seed), [], {}
    for resource in range(12):
        body = draw.randbytes(draw.randrange(1, 60))
        covered = [False] * len(body)
        for _ in range(draw.randrange(1, 9)):
            a = draw.randrange(len(body))
            n = draw.randrange(1, len(body) - a + 1)
            how = draw.choice(["partial", "partial", "whole", "other", "short", "error"])
            head = f"bytes {a}-{a + n - 1}/{len(body)}"
            if how == "whole":
                rows.append((resource, a, n, 200, None, body))
            elif how == "partial":
                rows.append((resource, a, n, 206, draw.choice([head, head.upper()]), body[a : a + n]))
            elif how == "other":
                rows.append((resource, a, n, 206, f"bytes {a + 1}-{a + n}/{len(body)}", body[a : a + n]))
            elif how == "short":
                rows.append((resource, a, n, 206, head, body[a : a + n - 1]))
            else:
                rows.append((resource, a, n, 500, None, b"oops"))
            if how in ("whole", "partial"):
                covered[a : a + n] = [True] * n
        known = any(r[0] == resource and r[3] in (200, 206) for r in rows)
        spans, at = [], None
        last = len(body) if known else max((i + 1 for i, c in enumerate(covered) if c), default=0)
        for i, c in enumerate([*covered[:last], True]):
            if not c and at is None:
                at = i
            elif c and at is not None:
                spans.append((at, i))
                at = None
        want[resource] = (len(body) if known else None, sum(covered), spans, body if known and all(covered) else None)
    found = ranges.assembled(ranges.pieces(spark.createDataFrame(rows, RESPONSE)))
    got = {r.resource: (r.total, r["size"], [tuple(h) for h in r.holes], None if r.body is None else bytes(r.body)) for r in found.collect()}
    assert got == want


def test_ranges_say_what_is_wrong(spark):
    rows = [(1, 0, 4, 206, "bytes 0-3/10", b"abcd"), (1, 4, 4, 206, "bytes 5-8/10", b"abcd"), (1, 4, 4, 206, None, b"abc"), (1, 4, 4, 404, None, b""), (1, 6, 4, 200, None, b"short"), (1, 4, 4, 206, None, None), (None, 0, 1, 200, None, b"a")]
    got = [r.fault for r in ranges.pieces(spark.createDataFrame(rows, RESPONSE)).collect()]
    assert got == [None, "other_range", "other_length", "refused", "other_length", "other_length", None]
    told = {r[0]: r[1] for r in spark.createDataFrame([("bytes 0-9/*",), ("bytes 5-4/9",), ("items 0-9/10",), (None,)], "c string").select("c", ranges.content_range(F.col("c"))).collect()}
    assert tuple(told["bytes 0-9/*"]) == (0, 10, None) and told["bytes 5-4/9"] is None and told["items 0-9/10"] is None and told[None] is None


# Polled tasks


def test_polls_grow_and_end(spark):
    times = services.poll_times()
    assert times[:4] == [0.0, 10.0, 21.0, 33.0] and times[20] == 390.0 and times[21] == 420.0 and times[-1] < 7200 <= times[-1] + 30
    draw, states = random.Random(4), {}
    for task in range(200):
        states[task] = sorted((draw.choice([0.0, 5.0, 10.0, 11.0, 20.0, 33.5, 100.0, 7190.0, 8000.0]), draw.choice(["PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELED"])) for _ in range(draw.randrange(4)))
    rows = [(t, *s) for t, own in states.items() for s in own]
    got = {r.task: (r.outcome, r.polls, r.ended) for r in services.polled(spark.createDataFrame([(t,) for t in states], "task long"), spark.createDataFrame(rows, "task long, at double, status string")).collect()}
    for task, own in states.items():
        want = ("timed_out", len(times), None)
        for n, at in enumerate(times, 1):
            upto = [s for s in own if s[0] <= at]
            if upto and max(upto)[1] in services.ENDS:
                want = (services.ENDS[max(upto)[1]], n, at)
                break
        assert got[task] == want, own


# Interfaces


def plain_fields(doc, schema, seen):
    if not isinstance(schema, dict) or id(schema) in seen:
        return set()
    seen.add(id(schema))
    if str(schema.get("$ref", "")).startswith("#/"):
        node = doc
        for part in schema["$ref"][2:].split("/"):
            node = node.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(node, dict) else None
        return plain_fields(doc, node, seen) if node else set()
    out = set(schema.get("properties", {}))
    for key in ("allOf", "anyOf", "oneOf"):
        for item in schema.get(key, []):
            out |= plain_fields(doc, item, seen)
    return out | plain_fields(doc, schema.get("items"), seen)


def test_fields_of_schemas_that_refer_in_cycles(spark):
    draw, docs = random.Random(6), []
    names = ["A", "B/x", "C~y", "D e", "E"]
    refs = ["#/s/" + n.replace("~", "~0").replace("/", "~1") for n in names] + ["#/s/none", "other.json#/A"]

    def schema(depth):
        kind = draw.choice(["ref", "ref", "properties", "all", "items"])
        if kind == "ref":
            return {"$ref": draw.choice(refs)}
        out = {"properties": {f"p{draw.randrange(30)}": {} for _ in range(draw.randrange(3))}}
        if depth and kind == "all":
            out[draw.choice(["allOf", "anyOf", "oneOf"])] = [schema(depth - 1) for _ in range(2)]
        if depth and kind == "items":
            out["items"] = schema(depth - 1)
        return out

    for _ in range(30):
        docs.append({"s": {n: schema(2) for n in names}, "start": schema(2)})
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc long, body string")
    got = {(r.doc, r.field) for r in services.schema_fields(table, table.select("doc", F.get_json_object("body", "$.start").alias("node"))).collect()}
    assert got == {(i, f) for i, d in enumerate(docs) for f in plain_fields(d, d["start"], set())}


def test_fields_need_no_broadcast_and_no_bound_on_references(spark):
    """Documents of small columns were broadcast whole, and references were followed 200 deep at most."""
    chain = {f"r{k}": {"$ref": f"#/s/r{k + 1}"} for k in range(300)} | {"r300": {"properties": {"end": {}}}}
    chained = json.dumps({"s": chain, "start": {"anyOf": [{"$ref": "#/s/r0"}, {"$ref": "#/list/1"}, {"$ref": "#/list/2"}, {"$ref": 5, "properties": {"own": {}}}]}, "list": [{}, {"properties": {"second": {}}}]})
    twice = '{"start": {"properties": {"kept": {}}, "properties": {"later": {}}, "n": ' + "9" * 900 + "}}"
    table = spark.createDataFrame([(1, chained), (2, twice), (3, '{"start": {'), (4, None), (5, "[" * 100_000)], "doc long, body string")
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        got = {(r.doc, r.field) for r in services.schema_fields(table, table.select("doc", F.get_json_object("body", "$.start").alias("node"))).collect()}
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
    assert got == {(1, "end"), (1, "second"), (1, "own"), (2, "kept")}


# Targets, retries, lists, the medium that is watched


def test_targets_match_in_three_ways(spark):
    schema = "tab long, id long, url string, kind string, ext string, role string, content_type string, picture boolean, ord long"
    site = "https://cdn{}.bilivideo.com/upgcxcode/a/{}-1-30280.m4s?x={}"
    known = [
        (1, 1, "https://h/720p/a.mp4?t=1", "media", None, None, None, None, 5), (1, 2, "https://h/128k/a.mp4", "media", None, None, None, None, 3), (1, 3, site.format(1, 77, 1), "audio", None, None, None, None, 1),
        (2, 4, "https://h/720p/a.mp4", "media", None, None, None, None, 1), (1, 5, None, None, None, None, None, None, 0), (1, 6, "", None, None, None, None, None, 0),
        *[(3, 100 + i, "https://hot/a.mp4", "media", None, None, None, None, 1000 - i) for i in range(500)],
    ]
    wanted = [
        (1, 10, "https://h/720p/a.mp4?t=1", "media", None, None, None, None, 0), (1, 11, "https://h/1080p/a.mp4?z", "media", None, None, None, None, 0), (1, 12, site.format(9, 77, 2), "audio", None, None, None, None, 0),
        (2, 13, "https://h/x/a.mp4", "media", None, None, None, None, 0), (1, 14, None, None, None, None, None, None, 0), *[(3, 1000 + i, "https://hot/a.mp4", "media", None, None, None, None, 0) for i in range(500)],
    ]
    got = {r.id: (r.target, r.by) for r in candidates.same_target(spark.createDataFrame(wanted, schema).drop("ord"), spark.createDataFrame(known, schema)).collect()}
    assert {i: got.get(i) for i in range(10, 15)} == {10: (2, "canonical"), 11: (2, "canonical"), 12: (3, "fingerprint"), 13: None, 14: None}
    assert all(got[1000 + i] == (599, "url") for i in range(500))


def test_retry_steps(spark):
    schema = "job long, chunk long, stage string, source_rows int, translated boolean, translation_failures int, asr_failures int, audio boolean"
    rows = [
        (1, 1, "failed", 5, True, 0, 0, True), (1, 2, "failed", 5, True, 0, 2, True), (1, 3, "failed", None, None, None, None, None), (1, 4, "translation", 5, False, 0, 0, True),
        (2, 1, "completed", 5, True, 0, 0, True), (2, 2, "completed", 5, True, 1, 0, True), (2, 3, "completed", 5, None, 0, 0, True), (2, 4, None, 5, True, 0, 1, True), (2, 5, "queued", 0, False, 0, 0, True),
        (3, 1, "completed", 5, True, 0, 0, True), (3, 2, "queued", 0, False, 0, 0, True), (3, 3, "queued", None, None, None, None, None), (4, 1, "queued", None, None, None, None, False),
    ]
    got = sorted(map(tuple, jobs.retry_steps(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, 1, "translate"), (1, 2, "recognise"), (1, 3, "recognise"), (2, 2, "translate"), (2, 3, "translate"), (2, 4, "recognise"), (3, 1, "translate"), (3, 2, "recognise")]


def test_lists_of_assets(spark):
    one = spark.createDataFrame([([("manifest", 75.0, None), (None, -3.0, "said"), ("", None, "")], [("a", None), (None, None), ("a", ""), (None, "m")], [("u", None, None, "video", -1.0, 2.0, None, 3, 4), (None, "n", None, None, None, None, None, None, None), ("v", "n", "s", "odd", None, None, None, -1, 5)]), (None, None, None)],
        "e array<struct<source:string,strength:double,detail:string>>, w array<struct<code:string,message:string>>, f array<struct<url:string,name:string,segment_type:string,role:string,duration:double,start:double,end:double,offset:long,length:long>>")
    first, none = one.select(assets.evidence_list(F.col("e")).alias("e"), assets.warning_list(F.col("w")).alias("w"), assets.fragment_list(F.col("f")).alias("f")).collect()
    assert [tuple(x) for x in first.e] == [("manifest", 75.0, ""), ("", 0.0, "said")] and [tuple(x) for x in first.w] == [("a", ""), ("", "m")]
    assert [tuple(x) for x in first.f] == [("u", "", "", "video", 0.0, 2.0, 0.0, 3, 4), ("v", "n", "s", "unknown", 0.0, 0.0, 0.0, None, None)]
    assert (none.e, none.w, none.f) == ([], [], None)
    told = spark.sql("select * from values ('manifest', 3.0D, null), ('odd', 3.0D, null), (null, 1.0D, 7.0D), ('manifest', 0.0D, 9.0D) t(s, d, n)").select(assets.duration_evidence(F.col("s"), F.col("d"), F.col("n"), F.lit(None).cast("string")).alias("x")).collect()
    assert [None if r.x is None else tuple(r.x) for r in told] == [("manifest", 3.0, 75.0, ""), ("odd", 3.0, 20.0, ""), ("inferred", 1.0, 7.0, ""), None]


def test_the_watched_medium_stays_unless_beaten(spark):
    schema = "media_id long, at long, ord long, score long, visible boolean, playing boolean"
    rows = [(1, 0, 1, 10, True, False), (1, 0, 2, 9, True, True), (1, 1, 1, 5, True, False), (1, 1, 2, 9, True, False), (1, 2, 1, 5, True, False), (1, 2, 2, 9, True, True), (1, 3, 1, 50, True, True), (1, 3, 2, 9, False, True), (1, 4, 2, 1, False, False), (1, 4, 3, 1, False, False), (2, 0, 5, 1, False, False)]
    got = sorted(map(tuple, folds.primary_medium(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 2), (2, 0, 5)]


# Attempts


def test_attempts_stop_by_their_own_state(spark):
    say = lambda *spans: json.dumps({"segments": [{"start": a, "end": b, "text": f"said from {a} on"} for a, b in spans]})
    chunks = [(c, 0.0, 100.0, clip, vad, True, True, known) for c, clip, vad, known in ((1, True, False, True), (2, True, False, True), (3, True, False, True), (4, False, True, True), (5, False, False, True), (6, False, False, False), (7, False, True, True))]
    recorded = [
        (1, True, False, False, say((0, 10), (20, 30))),  # enough
        (2, True, False, True, None), (2, False, False, False, say((0, 10), (20, 30))),  # refused with clips
        (3, True, False, False, say((0, 10))), (3, False, False, False, say((1, 9), (20, 30), (60, 70))),  # a gap that is filled
        (4, False, True, False, say()), (4, False, False, False, say((40, 47), (50, 70))),  # silence in which something substantial is said
        (5, False, False, True, None),  # no answer at all
        (6, False, False, False, say((0, 5))),  # nothing is known of its speech
        (7, False, True, False, say((0, 10))),  # a gap, but no request that is left
    ]
    speech = [(c, n, a, b) for c in (1, 2, 3, 6, 7) for n, (a, b) in enumerate(((0.0, 10.0), (20.0, 30.0)))]
    rows, outcomes = attempts.transcribe(spark.createDataFrame(chunks, "chunk_id long, start double, end double, clip boolean, vad boolean, precheck boolean, vad_supported boolean, known boolean"), spark.createDataFrame(recorded, "chunk_id long, clip boolean, vad boolean, failed boolean, payload string"), spark.createDataFrame(speech, "media_id long, idx long, s double, e double"), run_filters=False)
    assert sorted((r.media_id, r.s, r.attempt) for r in rows.collect()) == [(1, 0.0, 1), (1, 20.0, 1), (2, 0.0, 2), (2, 20.0, 2), (3, 0.0, 1), (3, 20.0, 2), (4, 40.0, 2), (6, 0.0, 1), (7, 0.0, 1)]
    assert {r.chunk_id: (r.requests, r.plan, r.failed) for r in outcomes.collect()} == {1: (1, None, False), 2: (2, "without_clips_refused", False), 3: (2, "without_clips", False), 4: (2, "empty", False), 5: (1, None, True), 6: (1, None, False), 7: (1, None, False)}


# Retention


def test_running_sums_in_slots_of_any_size(spark):
    draw = random.Random(11)
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), draw.randrange(300), n, draw.choice([None, 1, 5, 7])) for n in range(400)]
    table = spark.createDataFrame(rows, "owner string, at long, id long, bytes long")
    want = {n: (sum(r[3] or 0 for r in rows if r[0] == o and (r[1], r[2]) < (at, n)), sum(r[3] or 0 for r in rows if r[0] == o)) for o, at, n, _ in rows}
    for slot in (1, 10, 1000):
        got = retention.running_sums(table, ["owner"], F.floor(F.col("at") / slot), [F.col("at"), F.col("id")], {"x": F.col("bytes")}).collect()
        assert {r.id: (r.x_before, r.x_total) for r in got} == want


def test_a_cache_is_pruned_alike_in_any_slots(spark):
    draw = random.Random(12)
    rows = [(n, draw.choice(["hot", "hot", "b"]), draw.choice([0, draw.randrange(1, 40) * 86400, draw.randrange(4_000_000)]), draw.randrange(1, 2000), draw.random() < 0.1) for n in range(300)]
    table = spark.createDataFrame(rows, "id long, owner string, updated long, bytes long, protected boolean")
    found = [{r.id: r.kept for r in retention.prune_cache(table, F.lit(3_600_000), ["owner"], most_bytes=40_000, slot=slot).collect()} for slot in (60, 3600, 10**9)]
    assert found[0] == found[1] == found[2]
    for owner in ("hot", "b"):
        own = sorted((r for r in rows if r[1] == owner), key=lambda r: (-r[2], r[0]))
        live = [r for k, r in enumerate(own) if k < 80 and not 0 < r[2] < 3_600_000 - 30 * 86400]
        total, gone = sum(r[3] for r in live), set()
        for r in reversed(live):
            if total > 40_000 and not r[4]:
                gone.add(r[0])
                total -= r[3]
        assert all(found[0][r[0]] == (r[4] or (r in live and r[0] not in gone)) for r in own)
