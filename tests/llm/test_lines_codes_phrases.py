"""Line dedup, vector codes and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuetide.llm import codebooks, collocations, common, linededup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


# Lines


def plain_lines(rows, least_chars=40, least_documents=5):
    """(doc_id, kept, n_lines, n_dropped) of rows (doc_id, text)."""
    keyed = [(d, [(x, x.strip(" \t\n\x0b\x0c\r").translate(FOLD)) for x in (t or "").split("\n")]) for d, t in rows]
    holders = defaultdict(set)
    for d, lines in keyed:
        for _, key in lines:
            if len(key) >= least_chars:
                holders[key].add(d)
    rank = lambda d: float("-inf") if d is None else d
    top = {k: max(v, key=rank) for k, v in holders.items() if len(v) >= least_documents}
    out = []
    for d, lines in keyed:
        kept = [x for x, key in lines if key not in top or top[key] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=str)


EDGE = "É" * 39
SHARED = "The Shared line of a Footer that is long enough ÀB"
ROWS = [
    *[(i, f"own {i}\n{' ' * (i % 3)}{SHARED}\t\n\nshort\nshort") for i in range(8)],
    *[(i, f"{EDGE}\n{EDGE}x\n{EDGE}{'X' if i % 2 else 'x'} \r") for i in range(20, 25)],
    *[(i, "only four documents hold this line, so it stays here") for i in range(30, 34)],
    (3, f"{SHARED}\nagain the same id"),
    (3, f"{SHARED}\nagain the same id"),
    (7, f"{SHARED}\nof the largest id\n{SHARED}"),
    (None, SHARED),
    (None, f"a\n{SHARED}"),
    (40, None),
    (41, ""),
    (None, None),
    (42, "\n"),
    (43, f"{SHARED}\n{SHARED.translate(FOLD)}\n\x0b{SHARED}\x0c "),
]


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_by_definition(spark, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(parts)
    got = linededup.drop_repeated_lines(docs).select("doc_id", "kept", "n_lines", "n_dropped").collect()
    assert order(map(tuple, got)) == order(plain_lines(ROWS))
    assert sum(r.n_dropped for r in got) > 20


def test_lines_of_other_thresholds(spark):
    random.seed(5)
    rows = [(i % 17, "\n".join(random.choice(["aa", "bb ", " CC", "dd", "É", ""]) for _ in range(random.randrange(6)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_repeated_lines(docs, least_chars=1, least_documents=3).select("doc_id", "kept", "n_lines", "n_dropped").collect()
    assert order(map(tuple, got)) == order(plain_lines(rows, 1, 3))


def test_lines_with_clashing_columns_and_no_rows(spark):
    schema = "doc_id long, text string, doc int, body int, lost int, here int, pos int, hash int, n int, top int, line int, kept int, Here2 int"
    rows = [(i, SHARED, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) for i in range(6)]
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [""] * 5 + [SHARED]
    assert all((r.doc, r.body, r.lost, r.here, r.pos, r.hash, r.n, r.top, r.line, r.Here2) == (1, 2, 3, 4, 5, 6, 7, 8, 9, 11) for r in got)
    assert linededup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_of_a_very_long_text(spark):
    lines = [f"line number {i} of a very long text without an end" for i in range(60_000)]
    rows = [(i, "\n".join(lines)) for i in range(5)]
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_dropped, r.kept == (rows[4][1] if r.doc_id == 4 else "")) for r in got] == [(60_000, True)] * 4 + [(0, True)]


# Vector codes


def plain_codes(rows, parts, entries, rounds, scale=1024):
    """{row number: (code, error)} and the codebooks, by exhaustive search in Python numbers."""
    usable = [(n, v, [int(np.floor(scale * x)) for x in e]) for n, (v, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e)]
    usable.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    usable = [r for r in usable if len(r[2]) == len(usable[0][2])]
    if not usable:
        return {}, []
    width = len(usable[0][2]) // parts
    cut = lambda e, k: e[k * width : (k + 1) * width]
    books = [[cut(e, k) for _, _, e in usable[:entries]] for k in range(parts)]

    def nearest(book, p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for _, _, e in usable:
                members[nearest(books[k], cut(e, k))[1]].append(cut(e, k))
            for i, own in members.items():
                books[k][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {}
    for n, _, e in usable:
        found = [nearest(books[k], cut(e, k)) for k in range(parts)]
        out[n] = ("".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found))
    return out, books


def held(spark, rows, kind="float"):
    return spark.createDataFrame([(v, n, None if n % 3 == 0 else n % 2, e, n) for n, (v, e) in enumerate(rows)], f"vec_id long, place long, label int, embedding array<{kind}>, code int")


@pytest.mark.parametrize("seed,spread", [(1, 0.002), (2, 0.1), (3, 3e4)])
def test_codes_by_definition(spark, seed, spread):
    draw = np.random.default_rng(seed)
    base = [(i, [float(np.float32(x)) for x in draw.normal(0, spread, 12)]) for i in range(90)]
    bad = [(200, None), (201, [0.0] * 11 + [None]), (202, [float("nan")] * 12), (203, [float("-inf")] + [0.0] * 11), (204, []), (205, [1.0] * 8), (None, base[3][1]), (5, base[6][1]), (5, base[5][1])]
    rows = base + bad
    got = codebooks.compress(held(spark, rows).repartition(5), entries=16, rounds=3).collect()
    want, books = plain_codes(rows, 4, 16, 3)
    assert {r.place: (r.code, r.error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got) and None in sums
    restored = codebooks.decode([r.code for r in got], [np.array(b) for b in books])
    scaled = np.array([[int(np.floor(1024 * x)) for x in rows[r.place][1]] for r in got])
    assert ((restored - scaled) ** 2).sum(1).tolist() == [r.error for r in got]


def test_codes_of_few_and_no_rows(spark):
    rows = [(i, [0.5, -0.5, 0.25, 1.0]) for i in range(3)]
    got = codebooks.compress(held(spark, rows)).collect()
    assert [(r.code, r.error) for r in got] == [("00000000", 0)] * 3
    for nothing in (held(spark, [(1, None)]), held(spark, rows).where("false")):
        empty = codebooks.compress(nothing)
        assert empty.collect() == [] and {"code", "error", "label_error", "codebooks_sha256"} <= set(empty.columns)


def test_pruning_is_exact_at_ties_and_size_limits():
    draw = np.random.default_rng(9)
    for largest in (2, 50, 1 << 27):
        book = codebooks.Codebook(draw.integers(-largest, largest + 1, (256, 4)))
        parts = np.concatenate([draw.integers(-largest, largest + 1, (1500, 4)), book.entries])
        codes, apart = book.nearest(parts)
        every = ((parts[:, None, :].astype(object) - book.entries[None].astype(object)) ** 2).sum(2) if largest > 1 << 20 else ((parts[:, None, :] - book.entries[None]) ** 2).sum(2)
        assert apart.tolist() == every.min(1).tolist() and codes.tolist() == every.argmin(1).tolist()
    with pytest.raises(ValueError, match="too large"):
        codebooks.Codebook(np.array([[1 << 40] * 4])).nearest(np.array([[1] * 4]))


# Phrases


def plain_phrases(rows, most_words=5, least=100, most=2000, held_by=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            for size in range(1, most_words + 1):
                f.update((lang, words[i : i + size]) for i in range(len(words) - size + 1))
    kept = {k: c for k, c in f.items() if c >= least}
    found = defaultdict(list)
    for (lang, w), a in kept.items():
        if len(w) < 2:
            continue
        if any(o == lang and len(v) > len(w) and 100 * c >= held_by * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), c in kept.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (kept[lang, w[:k]] * kept[lang, w[k:]]), k, kept[lang, w[:k]], kept[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in found.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:most], 1))


def texts(seed, rows=120):
    draw = random.Random(seed)
    vocabulary = ["of", "The", "the", "é", "x-y", "I", "a b", "New", "york", "city"]
    fixed = ["new york city", "THE  end\tof the", "a b c d e f", "a b c d e f g"]
    out = []
    for _ in range(rows):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(9))) for _ in range(draw.randrange(8))]
        out.append((draw.choice(["en", "de", None, "und"]), draw.choice([". ", "\n", ",", " ! ", "\x0b", ""]).join(parts)))
    return [*out, ("en", None), (None, ""), ("fr", " .\t. "), *out[:20]]


@pytest.mark.parametrize("seed,least,bits,chunk", [(1, 2, 1 << 20, 1 << 20), (2, 4, 64, 1), (3, 9, 1 << 12, 300), (4, 500, 1 << 20, 1 << 20)])
def test_phrases_by_definition(spark, seed, least, bits, chunk):
    rows = texts(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, piece int").repartition(3)
    counts = collocations.count_phrases(docs, least=least, filter_bits=bits, chunk_bytes=chunk)
    got = collocations.top_phrases(collocations.score(counts), most=25, parts=3).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, least=least, most=25)


def test_phrases_held_by_a_share_of_longer_ones(spark):
    rows = texts(7)
    counts = collocations.count_phrases(spark.createDataFrame(rows, "lang string, text string"), most_words=3, least=2)
    got = collocations.top_phrases(collocations.score(counts, most_words=3, held_by=60), most=10_000).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 3, 2, 10_000, 60)


def test_phrase_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_007
    rows = [("en", "a", 1, 4 * big + 1), ("en", "b", 1, 2 * big + 3), ("en", "a b", 2, big)]
    counts = collocations.Counts(spark.createDataFrame(rows, "lang string, phrase string, size int, f long"), spark.createDataFrame([("en", 900 * big + 11)], "lang string, n long"))
    (row,) = collocations.score(counts).collect()
    assert row.score == 1000 * big * (900 * big + 11) // ((4 * big + 1) * (2 * big + 3))


def test_phrases_of_no_rows_and_long_texts(spark):
    empty = collocations.count_phrases(spark.createDataFrame([], "lang string, text string"))
    assert collocations.top_phrases(collocations.score(empty)).collect() == []
    long = ("one two three four " * 80_000)[:-1]
    counts = collocations.count_phrases(spark.createDataFrame([("en", long)], "lang string, text string"))
    got = {r.phrase: r.a for r in collocations.top_phrases(collocations.score(counts)).collect()}
    assert got["one two three four one"] == 79_999 and got["one two three four"] == 80_000
    # Held by the phrase of four words, as often as it occurs.
    assert "one two" not in got


def test_only_totals_are_broadcast(spark):
    docs = common.stored(spark.createDataFrame(texts(5), "lang string, text string"), "few-texts")
    plan = collocations.score(collocations.count_phrases(docs, least=2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") <= 1
