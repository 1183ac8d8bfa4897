"""Sources on inputs as they come: attributes in any order and quotes, escapes, broken parts, other kinds."""

import json
import random
import struct
import urllib.parse

import pytest
from pyspark.sql import functions as F

from cuetide.functions import urls
from cuetide.functions.times import iso_duration
from cuetide.operators import normalise
from cuetide.sources import events, manifests, players


def tag(draw, name, attributes, close=">"):
    """A tag with its attributes in any order, case of the name, quotes and space."""
    items = list(attributes.items())
    draw.shuffle(items)
    quote = lambda v: draw.choice(["'", '"']) if "'" not in v and '"' not in v else '"' if "'" in v else "'"
    parts = []
    for key, value in items:
        q = quote(value)
        parts.append(f"{key}{draw.choice(['=', ' = '])}{q}{value}{q}")
    return "<" + draw.choice([name, name.upper() if name.islower() else name]) + draw.choice([" ", "\n  "]) + draw.choice([" ", "\n"]).join(parts) + close


@pytest.mark.parametrize("seed", range(3))
def test_page_durations(spark, seed):
    draw, rows, want = random.Random(seed), [], {}
    forms = [("90", 90.0), ("PT1M1.5S", 61.5), ("250000", 250.0), ("PT2H", 7200.0), ("no", None), ("", None), ("0", None)]
    for i in range(60):
        html, found = ["<!doctype html><head>", '<meta name="author" content="duration">', tag(draw, "meta", {"property": "og:title", "content": "video:duration 55"})], None
        metas = [draw.choice(forms) for _ in range(draw.randrange(3))]
        for text, _ in metas:
            html.append(tag(draw, "meta", {draw.choice(["property", "itemprop", "name"]): draw.choice(["video:duration", "og:video:duration", "duration"]), "content": text, "data-content": "12"}))
        said = next((v for t, v in metas if t), "none")
        if said == "none" and draw.random() < 0.4:
            text, said = draw.choice([("PT5M", 300.0), ("2024-05-01", None)])
            html.append(f'<time class="x" datetime="{text}">')
        found = None if said == "none" else said
        for _ in range(draw.randrange(3)):
            text, seconds = draw.choice(forms[:5])
            body = draw.choice([{"@type": "VideoObject", "duration": text}, {"@graph": [{"name": "a"}, {"duration": text}]}, {"lengthSeconds": text}])
            html.append(f'<script id="a" type="application/ld+json">{json.dumps(body, indent=draw.choice([None, 2]))}</script>')
            found = seconds if found is None else found
        html.append('<script>var x = {"duration": 7}</script>')
        rows.append((i, "".join(html)))
        want[i] = found
    rows += [(900, None), (901, ""), (902, "<meta property=video:duration content=42>"), (903, '<meta content="43" property="video:duration"/>')]
    want |= {900: None, 901: None, 902: 42.0, 903: 43.0}
    got = {r.i: r.d for r in spark.createDataFrame(rows, "i long, html string").select("i", players.page_duration(F.col("html")).alias("d")).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_dash_attributes_in_any_form(spark, seed):
    draw, rows, want = random.Random(seed), [], {}
    for i in range(25):
        length, n = draw.randrange(1, 300), draw.randrange(1, 4)
        reps = []
        body = tag(draw, "MPD", {"mediaPresentationDuration": f"PT{length}S", "profiles": "urn:x", "type": "static"})
        body += tag(draw, "AdaptationSet", {"mimeType": "audio/mp4", "data-id": "no", "codecs": "mp4a.40.2"})
        for k in range(n):
            rep, rate = f"r{k}&amp;{draw.randrange(9)}", draw.randrange(1000)
            reps.append((rep.replace("&amp;", "&"), rate))
            body += tag(draw, "Representation", {"id": rep, "bandwidth": str(rate), "xlink:id": "other"}) + tag(draw, "SegmentTemplate", {"media": "a$Number$?x=1&amp;y=2", "timescale": "10", "duration": "50"}, "/>") + "</Representation>"
        rows.append((str(i), body + "</AdaptationSet></MPD>"))
        want[str(i)] = (float(length), [(r, b, "audio/mp4", "mp4a.40.2", "a$Number$?x=1&y=2", 10) for r, b in reps])
    table = spark.createDataFrame([*rows, ("none", ""), ("broken", "<MPD mediaPresentationDuration='PT"), ("null", None)], "url string, body string")
    found = {}
    for r in manifests.dash_representations(table).orderBy("url", "rep_no").collect():
        found.setdefault(r.url, (r.duration, []))[1].append((r.id, r.bandwidth, r.mime, r.codecs, r.media, r.timescale))
    assert found == want
    told = {r.url: r.d for r in table.select("url", iso_duration(manifests.dash_duration(F.col("body"))).alias("d")).collect()}
    assert all(told[u] == d for u, (d, _) in want.items()) and not any(told[u] for u in ("none", "broken", "null"))


def test_summaries_of_playlists(spark):
    rows = [("a", "#EXTM3U\r\n#EXTINF:4.5,title, with comma\r\nx.ts\r\n#EXTINF: 5\r\ny.ts"), ("b", "#EXTM3U\n#EXTINF:bad,\nx.ts\n#EXTINFO:9\n"), ("c", ""), ("d", "#EXTINF:1e3,\n#EXTINF:.5,\n")]
    got = {r.url: (r.segments, r.total) for r in manifests.summaries(spark.createDataFrame(rows, "url string, body string")).collect()}
    assert got == {"a": (2, 9.5), "b": (1, 0.0), "c": (0, 0.0), "d": (2, 1.5)}


def test_speech_lists_of_any_form(spark):
    cases = [
        ('{"x": 1}', None), ("", None), ("not json", None), (None, None), ('{"segments": []}', []), ("[]", []), (' [{"start": 1.5, "end": 9}]', [(1.5, 9.0)]),
        ('{"speech_segments": [{"start_ms": 1500, "end_ms": 2500}, {"start_ms": 500, "end_ms": 900}]}', [(0.5, 0.9), (1.5, 2.5)]), ('{"timestamps": [{"start_time": 2, "end_time": 3.5}]}', [(2.0, 3.5)]),
        ('[{"start": 1000, "end": 9000}]', [(1.0, 9.0)]), ('[{"start": 5, "end": 4}, {"start": 28, "end": 99.5}, {"start": null, "end": 3}, {"start_ms": 5, "end": 3}, {"start_ms": 7000, "end_ms": 8000, "start": 1, "end": 2}]', [(7.0, 8.0), (28.0, 30.0)]),
    ]
    table = spark.createDataFrame([(i, p, 0.0, 30.0) for i, (p, _) in enumerate(cases)], "chunk_id long, payload string, start double, end double")
    got = {r.chunk_id: None if r.intervals is None else [tuple(x) for x in r.intervals] for r in players.activity_payloads(table).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


@pytest.mark.parametrize("seed", range(2))
def test_player_formats_of_any_form(spark, seed):
    draw, rows, want = random.Random(seed), [], []
    for page in range(25):
        formats = []
        for k in range(draw.randrange(4)):
            url = f"https://h/{page}/{k}?a={draw.randrange(9)}&b=ü c"
            cipher = draw.random() < 0.4
            kind, codec = draw.choice([("audio", "opus"), ("audio", "mp4a.40.2"), ("video", "avc1.4d401f")])
            item = {"mimeType": f'{kind}/webm; codecs="{codec}"', "itag": k}
            if cipher:
                parts = [("s", "x=="), ("sp", "sig"), ("url", url)]
                draw.shuffle(parts)
                item[draw.choice(["signatureCipher", "cipher"])] = urllib.parse.urlencode(parts)
            else:
                item["url"] = url
            formats.append(item)
            want.append((page, url, codec, cipher))
        rows.append((page, json.dumps({"streamingData": {"adaptiveFormats": formats}, "other": ["x"]}, indent=draw.choice([None, 1]))))
    rows += [(900, "{}"), (901, None), (902, '{"streamingData": 5}'), (903, '{"streamingData": {"adaptiveFormats": [{"mimeType": "audio/webm"}, {}]}}')]
    found = players.player_formats(spark.createDataFrame(rows, "page_id long, payload string")).where("page_id < 900")
    assert sorted((r.page_id, r.url, r.codecs, r.needs_deciphering) for r in found.collect()) == sorted(want)


def box(name, body, wide=False):
    return (struct.pack(">I4sQ", 1, name, 16 + len(body)) if wide else struct.pack(">I4s", 8 + len(body), name)) + body


def test_roles_of_media_heads(spark):
    draw, cases = random.Random(2), []
    for _ in range(60):
        kinds = [draw.choice([b"soun", b"vide", b"text"]) for _ in range(draw.randrange(4))]
        tracks = b"".join(box(b"trak", box(b"tkhd", b"x" * draw.randrange(9)) + box(b"mdia", box(b"mdhd", b"") + box(b"hdlr", bytes(8) + k + bytes(draw.randrange(9))), draw.random() < 0.3)) for k in kinds)
        data = box(b"ftyp", b"isom") + draw.choice([b"", box(b"free", bytes(20))]) + box(b"moov", box(b"mvhd", bytes(4)) + tracks, draw.random() < 0.3)
        cases.append((data, "audio" if b"soun" in kinds and b"vide" not in kinds else "video" if b"vide" in kinds and b"soun" not in kinds else None))
    whole = cases[0][0]
    cases += [(b"", None), (None, None), (bytes(40), None), (struct.pack(">I4s", 5, b"moov") + bytes(20), None), (whole[:20], None), (struct.pack(">I4s", 1 << 31, b"moov") + bytes(20), None)]
    table = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)], "i long, c binary")
    got = {r.i: r.role for r in table.select("i", players.mp4_role(F.col("c")).alias("role")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_heads_of_payloads(spark):
    cases = [(b"ID3\x04", "mp3"), (b"\xff\xfb\x90", "mp3"), (b"\xff\xe3", "mp3"), (b"\xff\xdb", None), (b"RIFF\x01\x02\x03\x04WAVE", "wav"), (b"RIFF\x01\x02\x03\x04AVI ", None), (b"  \n<html>", "text"), (b"\t[1]", "text"), (b'{"error"', "text"), ("ü{".encode(), None), (b"", None), (None, None), (b" ", None)]
    table = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, (d, _) in enumerate(cases)], "i long, c binary")
    assert {r.i: r.h for r in table.select("i", players.audio_head(F.col("c")).alias("h")).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_codecs_and_containers(spark):
    codecs = [("mp4a.40.2, opus", True), (" MP4A.40.5 ", True), ("avc1.4d,mp4a", False), ("", False), (None, False), (",,", False), ("opusx", False), ("ec-3", True), ("flac,alac , vorbis", True)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c, _ in codecs], "c string").select(urls.codecs_are_audio(F.col("c"))).collect()]
    assert got == [w for _, w in codecs]
    names = [("http://h/a.M4S?x=.ts", "fmp4"), ("a.ts", "ts"), ("/x/y.cmfa", "fmp4"), ("https://h/a.mp4#t", "mp4#t"), ("", ""), (None, "")]
    assert [r[0] for r in spark.createDataFrame([(c,) for c, _ in names], "c string").select(urls.container_hint(F.col("c"))).collect()] == [w for _, w in names]


def test_network_events_of_any_kind(spark):
    rows = [
        (1, "https://h/a.mp3", "request-headers", None, None, True), (1, "https://h/page", "request-headers", None, None, False), (1, "https://h/a.m3u8?x", "request", "xmlhttprequest", None, True), (1, "https://h/a.mp3", "request", "image", None, False),
        (1, "https://h/data", "response", "other", "Audio/MPEG; charset=x", True), (1, "https://h/data", "response", "media", "application/octet-stream", False), (1, "https://h/a.ts", "response", "media", "application/octet-stream", True),
        (1, "https://h/data", "response", "media", None, False), (-1, "https://h/a.mp3", "request-headers", None, None, False), (None, "https://h/a.mp3", "request-headers", None, None, False), (1, None, "request-headers", None, None, False), (1, "", "request-headers", None, None, False),
        (1, "https://cdn.plyr.io/static/blank.mp4", "request-headers", None, None, False), (1, "https://h/a.mp3", None, "media", "audio/mpeg", False), (1, "HTTPS://H/A.MP3", "request-headers", None, None, True),
    ]
    table = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i long, tab long, url string, event string, request_type string, content_type string")
    assert {r.i for r in events.network_events(table).collect()} == {i for i, r in enumerate(rows) if r[5]}


def test_sniffed_texts_of_any_form(spark):
    cases = [
        ("#EXTM3U\n#EXTINF:1,\nhttps://h/a.ts", "hls", ["https://b/p"]), ("\ufeff#EXTM3U", "text", []), ("junk\n#EXTM3U\n", "hls", ["https://b/p"]), ('<?xml?>\n<MPD\nxmlns="urn:mpeg:dash:schema:mpd:2011">', "dash", ["https://b/p"]),
        ("see https://h/x.mp3&quot; and //c.d/y, (HTTP://H/z) https://h/x.mp3", "text", ["https://h/x.mp3", "https://c.d/y,", "HTTP://H/z"]), ("a &amp;lt; b https://h/q?a=1&amp;b=2", "text", ["https://h/q?a=1&b=2"]), (None, "text", []), ("", "text", []), ("// no url", "text", []),
    ]
    table = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i long, t string")
    got = {r.i: (r.x["format"], r.x["urls"]) for r in table.select("i", urls.sniffed(F.col("t"), F.lit("https://b/p")).alias("x")).collect()}
    assert got == {i: (f, u) for i, (_, f, u) in enumerate(cases)}


def test_payloads_that_fail(spark):
    cases = [
        ('{"text": "said"}', True), ('{"text": " \\n "}', False), ('{"result": {"text": "said"}}', True), ("{}", False), (None, False), ("broken {", False), ('{"text": "said", "segments": [{"text": "said", "start": 0, "end": 1}]}', False),
        ('{"text": "said", "segments": [{"text": "said"}]}', True), ('{"text": "said", "segments": [{"text": "said", "start": 2, "end": 1}]}', True), ('{"text": "a", "words": [{"word": "a", "start": 0, "end": 1}]}', False), ('{"text": 5}', True),
    ]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "chunk_id long, payload string")
    chunks = rows.select("chunk_id", F.lit(0.0).alias("start"), F.lit(900.0).alias("end"))
    assert {r.chunk_id for r in normalise.normalise(rows, chunks)[1].collect()} == {i for i, (_, fails) in enumerate(cases) if fails}
