"""Near-duplicates by exact similarity of shingles against brute force, and the pipeline's stage on planted copies."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_duplicates import united

from cuetide.llm import jaccard, simhash


def _planted():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice((60, 150, 400)))]
        texts.append(" ".join(text))
        for _ in range(12):
            copy = list(text)
            for _ in range(rnd.randint(1, 1 + len(text) // 30)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "a b c", "A b  c", "a b d", "x", "x"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def _components(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, root = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            either = len(sets[a] | sets[b])
            if a < b and (not either or len(sets[a] & sets[b]) / either >= 0.8):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in root}


def test_jaccard_against_brute_force(spark):
    rows = _planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _components(rows)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    assert jaccard.keep_first(docs.union(spark.createDataFrame([(None, "x")], docs.schema))).count() == len(set(want.values())) + 1
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_stage_finds_planted_copies(spark, sf):
    rows = _planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == set(_components(rows).values())


def test_stage_over_the_documents(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == set(_components(sorted(texts.items())).values())


def test_fingerprints_find_copies_before_minhash(spark, sf, monkeypatch):
    base = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join([*base[:1000], f"x{i}", *base[1001:]])) for i in range(8)] + [(50, "other text of some few words")]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string"), []
    plain = jaccard.likely_pairs
    monkeypatch.setattr(jaccard, "likely_pairs", lambda classes: seen.append(plain(classes)) or seen[-1])
    monkeypatch.setattr(jaccard, "let_go", lambda *tables: None)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == {0, 50}
    prints = [simhash.fingerprint_of(jaccard.shingle_set(t)) for _, t in rows]
    want = united(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    want = {(rows[c][0], k) for (k, _), c in zip(rows, want, strict=True) if rows[c][0] != k}
    assert want and {(r.a, r.b) for r in seen[0].collect()} == want


def test_sets_that_cannot_link_are_not_sent(spark, monkeypatch):
    rnd, kept, plain = random.Random(8), {}, jaccard.stored

    def keep(df, name):
        kept[name] = plain(df, name)
        return kept[name]

    monkeypatch.setattr(jaccard, "stored", keep)
    monkeypatch.setattr(jaccard, "let_go", lambda *tables: None)

    def changed(words, first, n):
        return [*words[:first], *(f"v{rnd.random()}" for _ in range(n)), *words[first + n :]]

    # Texts of similarity 0.6 to their origin and less to each other: they share keys, and a third of each is its own.
    origin = [f"u{i}" for i in range(300)]
    far = [origin, *(changed(origin, 20 * i, 70) for i in range(11))]
    rows = list(enumerate(" ".join(t) for t in far))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k, _ in rows} and kept["jaccard-open"].count() > 0
    assert kept["jaccard-rest"].count() == 0

    # Links to hubs are partly hidden, so that the join finds those within keys. It finds each that the keys hold.
    kept.clear()
    compared, rows = jaccard._compared, _planted()
    monkeypatch.setattr(jaccard, "_compared", lambda pairs, sets: compared(pairs, sets).withColumn("alike", F.expr("if((a + b) % 3 = 0, alike, least(alike, 0.78D))")))
    jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets, bands, want = {k: set(jaccard.shingle_set(t).tolist()) for k, t in rows}, {}, set()
    for r in kept["jaccard-open"].collect():
        bands.setdefault(r.band, []).append((r.rep, r.part))
    for held in bands.values():
        for a, part_a in held:
            want |= {(a, b) for b, part_b in held if a < b and part_a != part_b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) > 30 and {tuple(sorted((r.a, r.b))) for r in kept["jaccard-across"].collect()} == want
    assert kept["jaccard-rest"].select("part").distinct().count() > 2
