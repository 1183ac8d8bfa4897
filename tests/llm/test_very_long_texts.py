"""Texts of a megabyte and more, whose end counts as much as their start."""

from cuetide.llm import decontam, license, simhash, substring, urlfilter

WORDS = " ".join(f"w{i * 7919 % 100_003}" for i in range(200_000))


def test_long_texts_are_fingerprinted_whole(spark):
    other = WORDS[: len(WORDS) // 2] + " " + " ".join(f"v{i}" for i in range(150_000))
    rows = spark.createDataFrame([(5, WORDS, 1), (2, WORDS.upper(), 2), (9, other, 3)], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert len(WORDS) > 1_000_000 and got[5] == got[2] and got[5][1] == 2 and got[9][1] == 9


def test_repeats_at_the_end_of_long_texts(spark):
    tail = " ".join(f"t{i}" for i in range(60))
    rows = spark.createDataFrame([(1, WORDS + " " + tail), (2, " ".join(f"u{i}" for i in range(200_000)) + " " + tail), (3, WORDS)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(rows, length=50).collect()}
    assert got == {1: (200_060, 0), 2: (200_060, 60), 3: (200_000, 200_000)}


def test_benchmark_at_the_end_of_a_long_text(spark):
    rows = spark.createDataFrame([(1, WORDS + " a b c d e f g h i j"), (2, WORDS)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.report(decontam.find_hits(rows, bench)).collect()}
    assert got == {1: (200_010, 10), 2: (200_000, 0)}


def test_notice_at_the_end_of_a_long_text(spark):
    text = "license\n" * 150_000 + "# Licensed under the MIT License.\n"
    rows = spark.createDataFrame([("a/x.py", text, "mine", "mine"), ("a/LICENSE", text, "mine", "mine"), ("a/b/y.py", WORDS, "mine", "mine")], "path string, text string, near string, said string")
    got = {r.path: (r.own_license, r.license, r.near, r.said) for r in license.with_licenses(rows).collect()}
    assert got == {"a/x.py": ("MIT", "MIT", "mine", "mine"), "a/LICENSE": ("MIT", "MIT", "mine", "mine"), "a/b/y.py": (None, "MIT", "mine", "mine")}


def test_link_at_the_end_of_a_long_page(spark):
    rules = [urlfilter.Rule("good/", "allow"), urlfilter.Rule("bad/", "block")]
    rows = spark.createDataFrame([(1, "http://c/", "<p>" + WORDS + '</p><a href="http://bad/x">'), (2, "http://d/", "<p>" + WORDS + "</p>"), (3, "http://bad/", None), (4, "http://good/x", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(rows, rules).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
