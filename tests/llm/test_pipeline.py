"""The pipeline's stages: what each drops or changes."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_copies import _components as similar_components

from cuetide.llm import decontam, pii
from cuetide.llm.common import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) <= set(before)
        if name != "tokens":
            assert out.columns == columns
        if name == "language_id":
            assert len(rows) == len(before)
        if name == "near_duplicates":
            assert set(rows) == set(similar_components(sorted((k, r.text) for k, r in before.items())).values())
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontam.report(decontam.find_hits(out, bench)).where("contaminated").count() == 0
            assert all(rows[k].text == before[k].text for k in rows)
        if name == "personal_data":
            assert len(rows) == len(before) and all(r.n_chars == len(r.text) for r in rows.values())
            assert not any(re.search(r"@[a-z0-9]+\.example\.com|\+1 \(", r.text) for r in rows.values())
        if name == "tokens":
            assert len(rows) == len(before) and all(len(r.token_ids) == 4 * r.n_tokens for r in rows.values())
        path_rows = list(rows.values())
        docs, before = spark.createDataFrame(path_rows, out.schema), rows


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_edge_rows(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named as what stages add."""
    base = "the cat and the dog went to the house of the people and the water "
    rows = [(i, f"{base} number {i} " + " ".join(f"{c}{i}" for c in "abcdefghijkl"), "en", "s", 1) for i in range(40)]
    rows += [(1, rows[1][1], "en", "s", 1), (None, base * 3, None, None, None), (None, base * 3, "en", "s", 1)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (52, base * 4000, "en", None, 1), (53, "mail me at x@y.org " + base * 2, None, "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["score", "rejected", "lang_pred", "n_words", "hit_words", "row", "pii", "base", "more", "token_ids", "_other"]
    docs = spark.createDataFrame(rows, schema)
    for name in extra:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), f"edge-{name}")
        if name != "tokens":
            assert docs.columns == columns, name
            assert docs.where(" or ".join(f"{c} <> 'own {c}' or {c} is null" for c in extra)).count() == 0, name
        kept[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect())
    # No letters: rejected. Copies of a doc_id and rows without one stay.
    assert 50 not in kept["language_id"] and 51 not in kept["language_id"] and kept["language_id"].count(-1) == 2
    assert kept["near_duplicates"].count(1) == 2 and kept["near_duplicates"].count(-1) == 2
    assert kept["tokens"] == kept["personal_data"] == kept["decontamination"]
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        none = stored(stage(spark, none, sf), "edge-none")
        assert none.count() == 0


def test_redaction_of_planted_and_of_clean_texts(spark):
    """What is planted goes, and what stands around it stays to the letter; texts with none stay as they are."""
    rnd = random.Random(4)
    words = "the house with many small words that people read, in 1984 and 2024; chapter 12, section 3.2 of version 10.4 costs 1,200 or $3.50".split()
    say = lambda: " ".join(rnd.choice(words) for _ in range(30))
    planted = [("EMAIL", lambda i: f"user{i}@mail.example.org"), ("IP", lambda i: f"10.0.{i % 250}.7"), ("PHONE", lambda i: f"+1 (555) 010-{i:04}"), ("CARD", lambda i: "4111 1111 1111 1111"), ("SECRET", lambda i: f"a1b2{i:04}c3d4e5f6a7b8")]
    lead = {"SECRET": 'api_key = "', "EMAIL": "write to ", "IP": "host ", "PHONE": "call ", "CARD": "card "}
    rows, want = [], {}
    for i in range(200):
        kind, make = planted[i % 5]
        before, after = say() + " " + lead[kind], ('"; ' if kind == "SECRET" else "; ") + say()
        rows.append((i, before + make(i) + after))
        want[i] = before + f"[{kind}]" + after
    for i in range(200, 400):
        want[i] = say()
        rows.append((i, want[i]))
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    exact, clean = sum(got[i] == want[i] for i in range(200)), sum(got[i] == want[i] for i in range(200, 400))
    assert clean == 200 and exact == 200, (exact, clean)
