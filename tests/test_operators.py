"""Operators on small tables: edge rows, and folds against plain restatements (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuetide.functions import text as tx
from cuetide.functions import times as tm
from cuetide.functions import urls
from cuetide.operators import folds, guards, intervals, reconcile, retention, runs
from cuetide.sources import manifests, speech, subtitles

SEGMENTS = "media_id long, ord long, s double, e double, text string"
few = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_times(spark):
    got = values(spark, ["01:02:03,500", "02:03.25", "5", "a:b", "::7", None, "1:2:3:4"], tm.parse_timestamp)
    assert got == [3723.5, 123.25, None, None, 7.0, None, None]
    rows = spark.createDataFrame([(1.001,), (-3.0,), (3723.5,), (None,)], "t double")
    assert [r[0] for r in rows.select(tm.format_timestamp(F.col("t"))).collect()] == ["00:00:01.000", "00:00:00.000", "01:02:03.500", "00:00:00.000"]
    assert values(spark, ["PT1H2M3.5S", "P1D", "90", "200000", "P", "x", "P1W"], tm.duration_value) == [3723.5, 86400.0, 90.0, 200.0, None, None, 604800.0]


def test_texts(spark):
    assert values(spark, ["<b>a</b> &amp;lt; b", None, "﻿ x　y "], tx.clean_cue) == ["a < b", "", "x y"]
    assert values(spark, ["{\\i1}a\\Nb <i>&quot;c&#39;</i>"], tx.clean_import) == ["a b \"c'"]
    kinds = values(spark, ["...", "hahaha", "ok then", "嗯", "嗯嗯", "pfft", "zzz1", "", "aaaabbbb", "你好"], tx.information_kind)
    assert kinds == ["punctuation", "low_information", None, "low_information", "low_information", "low_information", None, None, "low_information", None]
    assert values(spark, ["zh_CN", "Auto", "PT-br", "JP", None], tx.language_code) == ["zh", "", "pt-br", "ja", ""]
    assert values(spark, ["a", "ab", ""], tx.content_signature) == ["1:97", "2:3105", "0:0"]


def test_urls(spark):
    got = values(spark, ["https://A.b/c/1280x720/x.mp4?b=2&utm_source=q&a=1#f", "nope", "http://h", None], urls.cache_url)
    assert got == ["https://A.b/c/1280x720/x.mp4?a=1&b=2", "nope", "http://h/", ""]
    assert values(spark, ["http://h/720p/f8-a1/seg-00012.m4s"], urls.canonical_url) == ["h/{quality}-{track}/seg-{track}.m4s"]
    assert values(spark, ["http://h/x.M3U8", "http://h/a?mime=audio%2Fmp4", "http://h/a.txt", "x"], urls.media_kind) == ["hls", "audio", None, None]


def test_unknown_speech_is_not_silence(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [(2.0, 1.0), (5.0, 6.0), (1.0, 2.0)])], "i int, a array<struct<start:double,end:double>>")
    got = [r[0] for r in rows.orderBy("i").select(intervals.normalised_array(F.col("a"))).collect()]
    assert got[0] is None and got[1] == [] and [tuple(x) for x in got[2]] == [(1.0, 2.0), (5.0, 6.0)]
    merged = rows.where("i = 3").select(intervals.merged_array(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0.0, 1.0), (1.15, 2.0), (2.16, 3.0))]))).first()[0]
    assert [tuple(x) for x in merged] == [(0.0, 2.0), (2.16, 3.0)]


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 9)), max_size=40))
def test_union_equals_the_fold(spark, rows):
    table = spark.createDataFrame([(m, i, s / 4, (s + d) / 4) for i, (m, s, d) in enumerate(rows)], "media_id long, ord long, s double, e double")
    want = []
    for m, s, e in sorted((m, s / 4, (s + d) / 4) for m, s, d in rows if d > 0):
        if want and want[-1][0] == m and s <= want[-1][2] + 0.15:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([m, s, e])
    got = sorted((r.media_id, r.s, r.e) for r in intervals.union(table).collect())
    assert got == [tuple(x) for x in want]


@few
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9), st.sampled_from("ab")), max_size=25))
def test_overlap_join_in_buckets(spark, rows):
    left = spark.createDataFrame([(1, i, float(s), float(s + d)) for i, (s, d, k) in enumerate(rows) if k == "a"], "media_id long, ord long, s double, e double")
    right = spark.createDataFrame([(1, i, float(s), float(s + d)) for i, (s, d, k) in enumerate(rows) if k == "b"], "media_id long, idx long, rs double, re double")
    plain = sorted(tuple(r) for r in intervals.overlap_join(left, right).select("ord", "idx").collect())
    assert plain == sorted(tuple(r) for r in intervals.overlap_join(left, right, bucket=4.0).select("ord", "idx").collect())


def test_repeated_runs(spark):
    rows = [(1, i, i * 2.0, i * 2.0 + 1.5, "Same again!" if i < 4 else "other") for i in range(6)] + [(2, i, float(i), i + 1.0, "short") for i in range(9)] + [(3, i, float(i), i + 3.0, "嗯嗯嗯") for i in range(4)]
    left = runs.drop_repeated_runs(spark.createDataFrame(rows, SEGMENTS))
    assert sorted((r.media_id, r.ord) for r in left.collect()) == [(1, 4), (1, 5)] + [(2, i) for i in range(9)]


def _low_runs(rows, kind, single):
    """The rule as a walk over rows in order: lone ones go at a run's head, long runs go whole."""
    out, i = [], 0
    while i < len(rows):
        if single(rows[i]):
            i += 1
            continue
        if kind(rows[i]) is None:
            out.append(rows[i])
            i += 1
            continue
        j = i
        while j < len(rows) and kind(rows[j]) is not None:
            j += 1
        run = rows[i:j]
        span = run[-1][3] - run[0][2]
        marks = all(kind(r) == "punctuation" for r in run)
        if not (len(run) >= (3 if marks else 5) and span >= (2 if marks else 10)):
            out += run
        i = j
    return out


@few
@given(st.lists(st.tuples(st.sampled_from(["...", "嗯", "hello there"]), st.integers(1, 5)), max_size=30))
def test_low_information_runs(spark, said):
    rows, at = [], 0.0
    for i, (t, d) in enumerate(said):
        rows.append((1, i, at, at + d, t))
        at += d
    kind = lambda r: {"...": "punctuation", "嗯": "low_information"}.get(r[4])
    want = _low_runs(rows, kind, lambda r: kind(r) == "low_information" and r[3] - r[2] >= 3)
    got = runs.drop_low_information(spark.createDataFrame(rows, SEGMENTS)).orderBy("ord").collect()
    assert [r.ord for r in got] == [r[1] for r in want]


def test_dropped_rows_keep_multiplicity(spark):
    rows = [(1, i, 1.0, 2.0, "x") for i in range(3)] + [(1, 9, 3.0, 4.0, "y")]
    before = spark.createDataFrame(rows, SEGMENTS)
    after = spark.createDataFrame([(1, 7, 1.0004, 2.0, "x")], SEGMENTS)
    assert sorted(r.ord for r in runs.dropped_rows(before, after).collect()) == [1, 2, 9]


def test_duplicates_merge_with_what_they_grew_to(spark):
    rows = [(1, 0, 0.0, 1.0, "a"), (1, 1, 1.2, 2.0, "a"), (1, 2, 2.21, 3.0, "a"), (1, 3, 2.95, 4.0, "a"), (1, 4, 4.1, 5.0, "b"), (1, 5, 4.2, 4.3, "b")]
    got = folds.merge_duplicates(spark.createDataFrame(rows, SEGMENTS)).orderBy("s").collect()
    assert [(r.ord, r.s, r.e) for r in got] == [(0, 0.0, 2.0), (2, 2.21, 4.0), (4, 4.1, 5.0)]


def test_packing(spark):
    rows = [(1, 0, 0.0, 20.0), (1, 1, 30.0, 45.0), (1, 2, 50.0, 120.0)]
    got = folds.pack_speech(spark.createDataFrame(rows, "media_id long, ord long, s double, e double")).orderBy("src_s").collect()
    assert [(r.bin, r.src_s, r.src_e, r.out_s, r.out_e) for r in got] == [(0, 0.0, 20.0, 0.0, 20.0), (1, 30.0, 45.0, 0.0, 15.0), (2, 50.0, 80.0, 0.0, 30.0), (3, 80.0, 110.0, 0.0, 30.0), (4, 110.0, 120.0, 0.0, 10.0)]


def test_reconcile_modes(spark):
    kind = "media_id long, chunk long, seg long, ord long, s double, e double, text string"
    src = spark.createDataFrame([(1, 0, 0, 0, 0.0, 1.0, "s0"), (1, 0, 1, 1, 1.0, 2.0, "s1"), (1, None, None, 2, 2.0, 3.0, "s2")], kind)
    tra = spark.createDataFrame([(1, 0, 0, 0, 0.0, 1.0, "old"), (1, 0, 0, 1, 0.0, 1.0, "new"), (1, None, None, 2, 2.0, 3.0, "t2"), (1, None, None, 5, 8.0, 9.0, "t5"), (1, 0, 7, 6, 7.0, 8.0, "t7")], kind)
    pairs = lambda mode: sorted((r.src_text or "", r.tra_text or "") for r in reconcile.reconcile(src, tra, mode).collect())
    assert pairs("panel") == [("", "t7"), ("s0", "new"), ("s1", ""), ("s2", "t2")]
    assert pairs("bilingual") == [("", "t2"), ("", "t5"), ("", "t7"), ("s0", "new"), ("s1", ""), ("s2", "")]
    assert pairs("live") == [("", "t5"), ("", "t7"), ("s0", "new"), ("s1", ""), ("s2", "t2")]


def test_alignment(spark):
    items = spark.createDataFrame([(1, 0, 1, "b"), (1, 1, 1, "again"), (1, 2, 9, "far"), (1, 3, None, " "), (1, 4, 2, "c")], "batch_id long, pos long, i long, text string")
    got = reconcile.align(items, spark.createDataFrame([(1, 4)], "batch_id long, n long")).orderBy("idx").collect()
    assert [(r.idx, r.text, r.invalid) for r in got] == [(0, None, 3), (1, "b", 3), (2, "c", 3), (3, None, 3)]


def test_retention_spares_protected_rows(spark):
    rows = [(1, "o", 100, 60, False), (2, "o", 90, 60, False), (3, "o", 80, 60, True), (4, "o", 0, 60, False)]
    table = spark.createDataFrame(rows, "id long, owner string, updated long, bytes long, protected boolean")
    kept = lambda **k: {r.id for r in retention.prune_cache(table, F.lit(100), ["owner"], **k).where("kept").collect()}
    assert kept(most_bytes=130) == {1, 3}
    assert kept(most=2) == {1, 2, 3}


def test_hallucination_order(spark):
    rows = spark.createDataFrame([(0, "long enough", 0.7, -0.5, 9.0), (1, "long enough", 0.7, -1.5, 1.0), (2, "long enough", 0.7, None, 9.0), (3, "long enough", 0.6, -2.0, 1.0), (4, "abc", 0.9, -2.0, 9.0), (5, "long enough", None, None, None)], "i int, t string, n double, l double, c double")
    got = [r[0] for r in rows.orderBy("i").select(guards.is_hallucinated(F.col("t"), F.col("n"), F.col("l"), F.col("c"))).collect()]
    assert got == [False, True, True, False, False, False]


def test_readers(spark):
    files = spark.createDataFrame([(1, "a.srt", "﻿1\r\n00:00:01,000 --> 00:00:02,500 align:x\r\nHi <b>there</b>\r\n&amp; you\r\n\r\nNOTE x\r\n\r\nbad\r\n"), (2, "b.ass", "[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.00,a\n; no\n[Other]\nDialogue: 0:00:03.00,0:00:04.00,x"), (3, "c.vtt", "WEBVTT\nKind: x\n\nid\n00:01.000 --> 00:02.000\nx\n\nSTYLE\na"), (4, "d", '{"transcript": {"translated": [{"start": 1, "end": 1, "text": "t"}, {"start": 3, "end": 2, "text": "u"}]}}'), (5, "e", None)], "file_id long, filename string, body string")
    got = sorted((r.file_id, r.s, r.e, r.text, r.format) for r in subtitles.read_any(files).collect())
    assert got == [(1, 1.0, 2.5, "Hi there & you", "srt"), (2, 1.0, 2.0, "a", "ass"), (3, 1.0, 2.0, "x", "vtt"), (4, 1.0, 1.0, "t", "json")]


def test_playlists(spark):
    body = '#EXTM3U\n#EXT-X-MAP:URI="i.mp4"\n#EXTINF:2.5,\n#EXT-X-BYTERANGE:10@5\na.mp4\n#EXT-X-KEY:METHOD=AES-128,URI="k,1"\n#EXTINF:2,\n#EXT-X-BYTERANGE:7\na.mp4\n#EXT-X-DISCONTINUITY\n#EXTINF:1,\nb.ts\n#EXT-X-KEY:METHOD=NONE\nc.ts'
    got = manifests.hls_segments(spark.createDataFrame([("u", body)], "url string, body string")).orderBy("idx").collect()
    assert [(r.uri, r.s, r.e, r.offset, r.length, r.key_uri, r.discontinuity) for r in got] == [("a.mp4", 0.0, 2.5, 5, 10, None, False), ("a.mp4", 2.5, 4.5, 15, 7, "k,1", False), ("b.ts", 4.5, 5.5, None, None, "k,1", True), ("c.ts", 5.5, 5.5, None, None, None, False)]
    mpd = '<MPD mediaPresentationDuration="PT10S"><AdaptationSet><SegmentTemplate timescale="10" media="$Number$"><SegmentTimeline><S t="0" d="20" r="-1"/><S t="60" d="20" r="-1"/></SegmentTimeline></SegmentTemplate><Representation id="x"/></AdaptationSet></MPD>'
    segs = manifests.dash_segments(manifests.dash_representations(spark.createDataFrame([("u", mpd)], "url string, body string"))).orderBy("number").collect()
    assert [(r.number, r.s, r.e) for r in segs] == [(i + 1, 2.0 * i, 2.0 * i + 2) for i in range(5)]


def test_silence_logs(spark):
    logs = spark.createDataFrame([(1, "silence_start: 4\nsilence_end: 8 | x", 20.0), (2, "", 5.0), (3, "silence_start: 3", 9.0), (4, "silence_end: 2\nsilence_start: 9", 10.0)], "media_id long, log string, duration double")
    got = sorted(tuple(r) for r in speech.speech_from_silence_log(logs).collect())
    assert got[0] == (1, 0.0, 4.4) and got[1][:2] == (1, 7.6) and (2, 0.0, 5.0) in got and (3, 0.0, 9.0) in got and [g[1:] for g in got if g[0] == 4] == [(1.6, 9.4)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SEGMENTS)
    assert intervals.union(none).count() == runs.drop_repeated_runs(none).count() == runs.drop_low_information(none).count() == folds.merge_duplicates(none).count() == intervals.pad(none).count() == 0
