"""WARC, Matroska, PII, URL and license operators against plain versions and round trips."""

import base64
import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import duckdb
import pytest

from cuetide.llm import license, license_texts, matroska, pii, queries, urlfilter, warc


def test_op5(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op5_warc(spark, sf).collect()}
    assert set(got) == set(pages)
    for page, body in pages.items():
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.fault) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response", None, None)


def test_warc_revisits_and_segments(spark):
    rows = [(i, None if i % 5 == 0 else f"http://x/{i}\n ü", None if i % 7 == 0 else ("same" if i % 3 else "x" * (i * 3000))) for i in range(40)] + [(None, "u", "same")]
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", folder, archive_bytes=20_000)
    got = {r.key: r for r in warc.read_archives(manifest, folder).collect()}
    assert len(got) == len(rows) and manifest.count() > 1 and not any(r.fault for r in got.values())
    last = {}
    for key, _, body in rows[:-1]:
        last[body or ""] = max(key, last.get(body or "", -1))
    for key, _, body in rows[:-1]:
        own = last[body or ""]
        assert (got[key].payload_bytes, got[key].record_type, got[key].refers_to) == (len(body or ""), "response" if own == key else "revisit", None if own == key else own)
    assert got[None].record_type == "response"


def test_warc_gives_back_every_row(spark):
    long, short = "x" * 40_000, "y"
    rows = [(1, "u", long)] * 3 + [(2, "u", long)] + [(None, "u", long)] * 4 + [(None, None, short)] * 2 + [(5, None, None)] * 2
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", folder)
    got = warc.read_archives(manifest, folder).collect()
    assert sorted((r.key or 0, r.payload_bytes) for r in got) == sorted((k or 0, len(b or "")) for k, _, b in rows)
    assert not any(r.fault for r in got) and [r.refers_to for r in got if r.key == 1] == [2] * 3
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html", folder)
    assert warc.read_archives(empty, folder).count() == 0


def test_reassembly_finds_what_is_missing(spark):
    body = b"z" * 50_000
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + warc.chunked(body)
    cut = [block[:20_000], block[20_000:40_000], block[40_000:]]

    def parts(origin, kept, total):
        return [(origin, "", n, total if n == 3 else None, "response" if n == 1 else "continuation", 1, "u", None, None, bytearray(cut[n - 1]), None, None, None) for n in kept]

    rows = parts("a", [3, 1, 2], len(block)) + parts("b", [1, 3], len(block)) + parts("c", [1, 2, 3], len(block) + 1) + parts("d", [1, 2], None)
    got = {r.origin: r for r in warc.reassemble(spark.createDataFrame(rows, warc._PART)).collect()}
    assert got["a"].payload_bytes == len(body) and got["a"].fault is None
    assert got["b"].fault and got["c"].fault and got["d"].fault and got["b"].payload_bytes is None
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


@pytest.mark.parametrize("lacing", ["fixed", "xiph", "ebml"])
def test_matroska_round_trip(lacing):
    for size in (64, 512, 4160, 30_016, 200_000):
        for frame in (512, 100, 5000):
            payload = random.Random(size).randbytes(size)
            data = matroska.write(payload, frame, 8, lacing)
            media = matroska.parse(data)
            assert b"".join(data[o : o + n] for _, _, o, n, _, _ in media.packets) == payload
            assert [p[1] for p in media.packets] == [i * frame * 125_000 for i in range(len(media.packets))]
            assert all(data[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in media.cues) and len(media.cues) == media.clusters


def test_matroska_unknown_sizes_groups_and_breaks(spark):
    m = matroska
    frames = b"ab" + b"cde"
    group = m._element(m.BLOCK_GROUP, m._element(m.BLOCK, b"\x81\x00\x05\x06" + b"\x01\x82" + frames) + m._number(m.BLOCK_DURATION, 9))
    cluster = m._id(m.CLUSTER) + b"\xff" + m._number(m.TIMESTAMP, 7) + group
    tracks = m._element(m.TRACKS, m._element(m.TRACK_ENTRY, m._number(m.TRACK_NUMBER, 1)))
    data = m._element(m.EBML, m._element(m.DOC_TYPE, b"matroska")) + m._id(m.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + tracks + cluster + cluster
    media = m.parse(data)
    assert [(p[1], data[p[2] : p[2] + p[3]], p[4]) for p in media.packets] == [(12_000_000, b"ab", True), (12_000_000, b"cde", True)] * 2 and media.clusters == 2
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[: len(data) // 2 - 3])), (3, None)], "k long, media binary")
    got = {r.k: r for r in m.with_packets(rows).collect()}
    assert len(got[1].packets) == 4 and got[1].media_error is None and got[2].media_error and got[3].packets == []
    assert m.packet_table(rows.where("k = 1"), "k").count() == 4
    told = {r.k: r for r in m.with_media_digests(rows).collect()}
    assert told[1].payload_bytes == 10 and told[2].payload_sha256 is None and told[2].media_bytes and told[3].media_bytes is None


def test_features_are_those_of_the_samples(spark):
    text = "Ünï " * 700
    data = text.encode() + bytes(-len(text.encode()) % 64)
    row = matroska.with_media_digests(matroska.with_media(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, feature string"))).first()
    packets = -(-len(data) // matroska.FRAME_BYTES)
    clusters = -(-packets // (matroska.LACED_FRAMES * matroska.BLOCKS_IN_CLUSTER))
    want = f"matroska;A_PCM/INT/LIT;8000Hz;8bit;clusters={clusters};cues={clusters};packets={packets};ms={len(data) / 8:.3f};min={min(data)};max={max(data)};mean={sum(data) / len(data):.4f}"
    assert row.feature == want


def test_op10(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op10_matroska(spark, sf).collect()}
    for doc, text in texts.items():
        data = text.encode()
        body = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert r.media_sha256 == hashlib.sha256(matroska.write(body)).hexdigest()


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_op3(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op3_pii(spark, sf).collect()}
    for doc, text in texts.items():
        want = base_spans(text)
        r = got[doc]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in KINDS]


def test_pii_on_random_and_hostile_texts(spark):
    rnd = random.Random(3)
    parts = ["1", "22", "333", "4.", ".5", "-", "+", "+1 (", " ", "a", "@", "b.c", "é", "😀", "255.1", ".1.1", "4111 1111 1111 1111", "x@y.z", "%", "(", "token = \"a1b2c3d4e5f60718\" ", "Mr Max Miller "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50)))) for i in range(600)] + [(9001, None), (9002, ""), (9003, "7" * 20_000), (9004, "a" * 20_000), (9005, "1." * 3000), (9006, "a." * 2000 + "@b"), (9007, "+1" + " " * 2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(frame).collect()}
    for doc, text in rows:
        assert got[doc].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
    spans = " ".join(r.spans for r in got.values())
    assert "secret:" in spans
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[9001] is None and clean[9002] == ""
    assert all(not re.search(r"x@y\.z", t or "") for t in clean.values())
    assert pii.report(frame.limit(0)).count() == 0


def test_estimated_reliability():
    counts = {"2221": 50, "2211": 40, "0001": 60, "0010": 30, "2001": 5, "1111": 3}
    belief = pii.estimate(counts)
    assert belief["2221"] > 0.95 and belief["0001"] < 0.05 and pii.estimate({}) == {}


def test_op7(spark, sf):
    got = {r.page_id: r for r in queries.op7_url_filter(spark, sf).collect()}
    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    for page, host, path, rule, verdict in duckdb.sql(urlfilter.ORACLE_RULES).fetchall():
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


def test_url_edge_rows_and_many_rules(spark):
    rows = [(1, None), (2, "nope"), (3, "HTTP://A.Example.NET/en/x?q#f"), (4, "http://example.net"), (5, "x://y://z/"), (6, "http://org/fr/?"), (7, "http://notorg/fr/")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    plain = {r.page_id: (r.host, r.path, r.rule, r.rule_verdict) for r in urlfilter.with_rules(frame, urlfilter.RULES).collect()}
    assert plain[1] == plain[2] == ("", "", None, None) and plain[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and plain[4] == ("example.net", "", None, None)
    assert plain[5] == ("y:", "//z/", None, None) and plain[6][2] == "org/fr/" and plain[7][2] is None
    many = urlfilter.RULES + [urlfilter.Rule(f"h{i}.example/x/", "block") for i in range(300)]
    assert plain == {r.page_id: (r.host, r.path, r.rule, r.rule_verdict) for r in urlfilter.with_rules(frame, many).collect()}


def test_propagation(spark):
    links = [("good", "a", 2.0), ("good", "b", 1.0), ("a", "b", 1.0), ("c", "bad", 1.0), ("d", "c", 3.0), ("d", "good", 1.0)]
    seeds = [("good", 1.0, 0.0), ("bad", 0.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(spark.createDataFrame(links, "source string, target string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    hosts = sorted({x for a, b, _ in links for x in (a, b)})
    rank = {h: [float(h == "good"), float(h == "bad")] for h in hosts}
    for _ in range(200):
        new = {h: [0.15 * (h == "good"), 0.15 * (h == "bad")] for h in hosts}
        for a, b, w in links:
            new[b][0] += 0.85 * rank[a][0] * w / sum(x for s, _, x in links if s == a)
            new[a][1] += 0.85 * rank[b][1] * w / sum(x for _, t, x in links if t == b)
        rank = new
    for h, (t, d) in got.items():
        assert abs(t - rank[h][0]) < 1e-4 and abs(d - rank[h][1]) < 1e-4
    pages = [(1, "http://good/x", '<a href="http://a/">'), (2, "http://c/", '<a HREF=//BAD/x>'), (3, "http://bad/", None), (4, "http://lonely/", "")]
    rules = [urlfilter.Rule("good/", "allow"), urlfilter.Rule("bad/", "block")]
    verdicts = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert verdicts == {1: "allow", 2: "block", 3: "block", 4: "allow"}


def test_licenses(spark):
    rows = [("r/LICENSE", "Released under the MIT License."), ("r/a/b/x.py", "code"), ("r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("r/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code words here and there " * 9), ("q/z", None), (None, ""), ("r/w", "the license of the work is"), ("r/LICENSE", "Released under the MIT License.")]
    got = [(r.path, r.own_license, r.license, r.found_in) for r in license.with_licenses(spark.createDataFrame(rows, "path string, text string")).collect()]
    assert got.count(("r/LICENSE", "MIT", "MIT", None)) == 2
    assert ("r/a/b/x.py", None, "GPL-3.0", "r/a") in got and ("r/a/b/y.py", "Apache-2.0", "Apache-2.0", None) in got
    assert ("q/z", None, None, None) in got and (None, None, None, None) in got and ("r/w", None, "MIT", "r") in got
    assert license.with_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_anchors_lose_nothing():
    known, whole = license.Templates(license.TEMPLATES, 0.6), license.Templates(license.TEMPLATES, 0.0)
    rnd = random.Random(5)
    terms = sorted(whole.weights) + ["zz", "yy"]
    for _ in range(500):
        line = [rnd.choice(terms) for _ in range(rnd.randint(1, 12))]
        assert not known.anchors.isdisjoint(line) or whole.best(line)[0] < 0.6


def license_cosines(templates):
    """A plain version: dictionaries of weights, each product in full."""
    bags = [Counter(re.findall(r"[^\W_]+", t.lower())) for _, t in templates]
    idf = {t: math.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1 for b in bags for t in b}
    weigh = lambda bag: {t: n * idf.get(t, math.log(1 + len(bags)) + 1) for t, n in bag.items()}
    size = lambda w: math.sqrt(sum(x * x for x in w.values()))
    vectors = [weigh(b) for b in bags]

    def nearest(terms):
        own = weigh(Counter(terms))
        best = (0.0, None)
        for (name, _), v in zip(templates, vectors, strict=True):
            if all(t in own for t in v if t.isdigit()) and own:
                cosine = sum(x * own.get(t, 0) for t, x in v.items()) / size(v) / size(own)
                if cosine > best[0] + 1e-12:
                    best = (cosine, name)
        return best

    return nearest, max(sum(b.values()) for b in bags)


def test_op8(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op8_license(spark, sf).collect()}
    assert set(got) == set(texts)
    (notice, longest), (whole, _) = license_cosines(license.TEMPLATES), license_cosines(license.TEXTS)
    own, declared, paths = {}, {}, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang").collect():
        levels = [r.source or "none", r.lang or "none", f"part{r.doc_id % 3}", "src"]
        paths[r.doc_id] = levels[: r.doc_id // 4 % 3 + 1] if r.doc_id % 4 == 0 else levels
    for doc, text in texts.items():
        terms = re.findall(r"[^\W_]+", text.lower())
        cosine, name = whole(terms)
        if cosine < license.FILE_COSINE:
            lines = [re.findall(r"[^\W_]+", re.sub(r"^\s*(?:rem|dnl)\b", "", line)) for line in text.lower().split("\n")]
            cosine, name = 0.0, None
            for i in range(len(lines)):
                for j in range(i + 1, len(lines) + 1):
                    run = sum(lines[i:j], [])
                    if len(run) > 2 * longest and j > i + 1:
                        break
                    # Only runs with a word of licenses can come near, which saves time here.
                    if any(t.startswith(("licen", "permi", "redis", "copy")) for t in run) and (found := notice(run))[0] > cosine + 1e-12:
                        cosine, name = found
            name = name if cosine >= license.HEADER_COSINE else None
        if name and (cosine >= license.FILE_COSINE and whole(terms)[1] == name and whole(terms)[0] == cosine or doc % 4 == 0):
            declared.setdefault(tuple(paths[doc]), []).append((-cosine, name))
        own[doc] = name
    for doc in texts:
        above = [tuple(paths[doc][:k]) for k in range(len(paths[doc]), -1, -1)]
        near = next((d for d in above if d in declared), None)
        inherited = min(declared[near])[1] if near else None
        assert (got[doc].own_license, got[doc].license) == (own[doc], own[doc] or inherited), doc
        if inherited and not own[doc]:
            assert got[doc].found_in == "/".join(near)


def test_op8_inherits_from_every_depth(spark):
    """The nearest directory above, in plain Python, from the rows' own licenses; the smallest tables have too few of them."""
    rows = queries.op8_license(spark, "/root/testdata/sf0.01").collect()
    declared = {}
    for r in rows:
        if r.is_license_file:
            declared.setdefault(r.path.rpartition("/")[0], []).append((-r.own_cosine, r.own_license))
    depths = set()
    for r in rows:
        levels = r.path.split("/")[:-1]
        near = next((d for k in range(len(levels), -1, -1) if (d := "/".join(levels[:k])) in declared), None)
        if r.own_license is None and near is not None:
            assert (r.license, r.found_in) == (min(declared[near])[1], near), r.doc_id
            depths.add(near.count("/"))
        else:
            assert (r.license, r.found_in) == (r.own_license, None), r.doc_id
    assert depths == {0, 1, 2}


def test_notices_in_very_long_texts():
    """A notice among very many lines that hold a word of it, or nothing, is found in seconds."""
    known = license.Templates(license.TEMPLATES, license.HEADER_COSINE)
    notice = [["licensed", "under", "the", "mit", "license"]]
    began = time.perf_counter()
    for filler in ([["license"]] * 130_000, [["license", f"w{i}"] for i in range(40_000)], [["license"], *[[]] * 1000] * 150):
        assert known.best_run(filler)[1] == -1
        cosine, name, first = known.best_run([*filler, *notice, *filler[:9]])
        assert cosine > 0.9 and known.names[name] == "MIT" and first == len(filler)
    assert time.perf_counter() - began < 90


def test_licenses_are_told_apart(spark):
    code = "\n" + "value = compute(1) + other\n" * 60
    wrap = lambda text, mark="# ": "\n".join(mark + line for line in textwrap.wrap(text, 60))
    mit, bsd2, bsd3 = (next(t for n, t in license.TEXTS if n == name) for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause"))
    cases = [
        ("a/x.py", wrap(license_texts._GPL.format("", "3")) + code, "GPL-3.0", False),
        ("b/x.py", wrap(license_texts._GPL.format("", "2"), " * ") + code, "GPL-2.0", False),
        ("c/x.py", wrap(license_texts._GPL.format("Lesser ", "3"), "// ") + code, "LGPL-3.0", False),
        ("d/x.py", wrap(license_texts._GPL.format("", "4")) + code, None, False),
        ("e/note.txt", "Licensed under the GNU General Public License, version 2", "GPL-2.0", False),
        ("f/LICENSE", "Copyright 2020 A. Person\n\n" + textwrap.fill(mit, 70), "MIT", True),
        ("g/any.txt", "Copyright (c) 1999, The Regents\n" + textwrap.fill(bsd2, 70), "BSD-2-Clause", True),
        ("h/COPYING", "Copyright (c) 1999, The Regents\n" + textwrap.fill(bsd3, 70), "BSD-3-Clause", True),
        ("i/COPYING.md", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + "words of the long text " * 50, "GPL-3.0", True),
        ("e/other.py", code, None, False),
        ("f/sub/deep/other.py", code, None, False),
    ]
    rows = spark.createDataFrame([(p, t, "x", "y") for p, t, _, _ in cases], "path string, text string, here string, at string")
    got = {r.path: r for r in license.with_licenses(rows).collect()}
    for path, _, name, is_file in cases:
        assert (got[path].own_license, got[path].is_license_file) == (name, is_file), path
        assert (got[path].here, got[path].at) == ("x", "y")
    assert got["f/sub/deep/other.py"].license == "MIT" and got["e/other.py"].license is None


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    for table in ("documents", "benchmark", "pages", "embeddings"):
        duckdb.sql(f"create or replace view {table} as select * from '{sf}/{table}.parquet'")
    frame = queries.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    want = duckdb.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(str(r[i]) for i in places) for r in want.fetchall())
