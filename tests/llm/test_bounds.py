"""Both sides of every bound on what is handled at once: results must not depend on it."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_duplicates import brute_hits

from cuetide.llm import bpe, decontam, langid, queries, substring


def test_bpe_cuts_where_the_tokenizer_sees_white_space():
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(queries.tokenizer_path()), bpe.WordBPE(bpe.load_spec(queries.tokenizer_path()))
    for middle in ("!!\x1c!!", "!! !!", "a\x1d\x1e\x1fb", "a b", "x" * 50):
        text = "x " * (bpe.PIECE_CHARS // 2 - 1) + middle + " y" * 20
        assert len(text) > bpe.PIECE_CHARS
        assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

def test_bpe_learns_few_texts_at_once_and_keeps_a_string_once(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    spec = bpe.load_spec(queries.tokenizer_path())
    texts = [" ".join(f"w{i * n}" for i in range(2_000)) for n in range(1, 80)] + [None, ""]
    kept = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: kept.append(run) or self)
    bpe.encode(spark.createDataFrame([], "text string"), spec)
    sizes, plain = [], bpe.WordBPE.encode_batch
    monkeypatch.setattr(bpe.WordBPE, "encode_batch", lambda self, values: sizes.append(sum(len(v or "") for v in values)) or plain(self, values))
    out = pa.Table.from_batches(kept[0](iter([pa.RecordBatch.from_pydict({"text": texts})]))).column("token_ids").to_pylist()
    assert sum(sizes) > 900_000 and max(sizes) <= 300_000
    model = bpe.WordBPE(spec)
    assert out == [plain(model, [t])[0] for t in texts]
    single = bpe.WordBPE(spec)
    single.encode("alpha beta gamma")
    assert len(single.chunks) == 3 and {id(c) for c in single.chunks} == {id(w) for w in single.known}


def test_bpe_learns_a_word_in_few_calls():
    """Each symbol's last token is looked up in place, among tokens that end there."""
    import random
    import sys

    spec = bpe.load_spec(queries.tokenizer_path())
    model, rnd, calls = bpe.WordBPE(spec), random.Random(4), 0
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 14))) for _ in range(4_000)]
    model.encode(" ".join(words))
    model.known, model.chunks = {}, {}

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        got = model.encode(" ".join(words))
    finally:
        sys.setprofile(None)
    from tokenizers import Tokenizer

    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_str(spec).encode(" ".join(words), add_special_tokens=False).ids
    assert calls < 2 * len(words)


def test_tokens_that_end_at_a_symbol():
    inner, final = {"a": 0, "b": 1, "ab": 2, "bab": 3, "abba": 4}, {"a": 5, "b": 6, "ba": 7, "babb": 8}
    suffixes, state, text = bpe._Suffixes(inner, final), 0, "abbababbabbaabab"
    for end in range(1, len(text) + 1):
        state = suffixes.after(state, text[end - 1])
        for kind, tokens in enumerate((inner, final)):
            want = [(tokens[text[at:end]], end - at) for at in range(end) if text[at:end] in tokens]
            assert suffixes.tokens(state, bool(kind)) == want


def test_decontamination_gives_the_same_in_any_number_of_blocks(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, long), (3, "tiny"), (1, "ten nine eight seven six five four three two one")]
    part = " ".join(f"w{i}" for i in range(7, 29))
    rows = [(None, f"a {part} b"), (None, "clean"), (5, "one two three four five six seven eight nine ten x tiny"), (5, "nothing here"), (5, "nothing here"), (6, None)]
    schema = "doc_id long, text string, n_words string, hit_words string, row string"
    docs = spark.createDataFrame([(d, t, "mine", "mine", "mine") for d, t in rows], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_hits(dict(enumerate(t for _, t in rows)), items).values())
    for block in (1, 4, 12, 1000):
        found = decontam.report(decontam.find_hits(docs, bench, block_windows=block)).collect()
        assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == want
        kept = decontam.drop_contaminated(docs, bench, block_windows=block)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "", r.n_words, r.hit_words, r.row) for r in kept.collect()) == sorted((d or 0, t or "", "mine", "mine", "mine") for d, t in (rows[1], *rows[3:]))
        cut = decontam.remove_spans(docs, bench, block_windows=block)
        assert cut.columns == docs.columns and sorted(r.text or "" for r in cut.collect()) == ["", "  x  ", "a   b", "clean", "nothing here", "nothing here"]


def test_every_label_is_learned(spark):
    letters = [chr(0x4E00 + i) for i in range(205)]
    rows = [(i * 205 + at, (c + "ab ") * 5, f"l{at:03}") for at, c in enumerate(letters) for i in range(6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 205
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "MOST_LANGUAGES", 204)
        with pytest.raises(ValueError):
            langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_two_hundred_languages_take_little_of_the_driver(spark):
    """The driver holds 12 bytes for each n-gram of each language, not a row of all languages for each n-gram."""
    import random
    import tracemalloc

    draw = random.Random(3)
    rows = []
    for at in range(200):
        letters = "".join(draw.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñ", 12))
        rows += [(200 * i + at, " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(60)), f"l{at:03}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    tracemalloc.start()
    model = langid.train(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 200 and peak < 200 << 20
    held = docs.where(langid.held_out(F.col("doc_id")))
    right = langid.predict(held, model).selectExpr("avg(int(lang_pred = lang))").first()[0]
    assert right > 0.9


def test_characters_of_the_sample_are_bounded(spark):
    rows = [(i, ("ab" if i % 2 else "cd") * 500, "x" if i % 2 else "y") for i in range(100)]
    labelled = spark.createDataFrame(rows, "key string, text string, lang string")
    sizes = {"x": 50, "y": 50}
    got = {r.lang: (r["n"], r["nth"]) for r in langid._sample(labelled, sizes, 400, 4500).groupBy("lang").agg(F.count("*").alias("n"), F.max("nth").alias("nth")).collect()}
    assert got == {"x": (4, 4), "y": (4, 4)}
    # A first row stays even if it alone is longer.
    assert langid._sample(labelled, sizes, 400, 10).count() == 2


def test_items_without_an_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "x e f g h y"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d"), (7, "e f g h"), (None, "e f g h"), (None, None)], "item_id long, text string")
    for block in (1, 2, 1000):
        got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(decontam.find_hits(docs, bench, n=3, block_windows=block)).collect()}
        assert got == {1: (4, 0, decontam.items_digest([]), True), 2: (4, 1, decontam.items_digest(["7"]), True), 3: (0, 0, decontam.items_digest([]), False)}
        assert [r.doc_id for r in decontam.drop_contaminated(docs, bench, n=3, block_windows=block).collect()] == [3]


def test_blocks_of_symbols_change_nothing(monkeypatch):
    counts = {"x": {"\x02a": 3, "\x02b": 1, "\x02ab": 3, "ab\x03": 2, "aba": 1, "ba\x03": 1}, "y": {"\x02q": 2, "\x02q\x03": 2}}
    model = langid.fit(counts, 3)
    words = ["ab", "q" * 50, "aba" * 40, "b", "zz", "ab"]
    want = model.score_words(words)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = model.score_words(words)
        assert np.allclose(got[0], want[0], atol=1e-3) and got[1].tolist() == want[1].tolist()


def test_recognised_rows_keep_their_columns(spark):
    rows = [(2 * i + j, t, lang, "mine", 7) for i in range(60) for j, (t, lang) in enumerate((("the cat and the dog", "en"), ("der hund und die katze", "de")))]
    table = spark.createDataFrame([*rows, (999, None, "en", "mine", 7), (998, "漢字" * 40, None, "mine", 7)], "doc_id long, text string, lang string, score string, rejected long")
    kept = langid.keep_recognised(table, langid.train(table))
    assert kept.columns == table.columns and sorted(map(tuple, kept.collect())) == sorted(rows)
    # Without a model nothing is known of any text, so all stay.
    none = langid.train(table.where("false"))
    assert langid.keep_recognised(table, none).count() == len(rows) + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.lists(st.integers(0, 6), max_size=6)), max_size=24), st.integers(0, 4), st.integers(1, 6), st.booleans())
def test_settling_tells_all_repeats(documents, hot, slice_docs, wide):
    kind = substring.PAIR if wide else np.dtype(np.uint64)

    def as_hashes(values):
        out = np.empty(len(values), kind)
        if wide:
            # Equal first halves must not be taken for equal hashes.
            out["a"], out["b"] = [v // 2 for v in values], [v % 2 for v in values]
        else:
            out[:] = values
        return out

    holders = defaultdict(set)
    for doc, values in documents:
        for v in values:
            holders[v].add(doc)
    for settle_all in (True, False):
        sent = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(substring, "HOT", hot)
            # Rows of one document are in one task.
            for task in range(3):
                own, settler = [d for d in documents if d[0] % 3 == task], substring._Settler(kind, settle_all)
                for first in range(0, len(own), slice_docs):
                    part = own[first : first + slice_docs]
                    h, d, s = settler.rows([as_hashes(v) for _, v in part], [doc for doc, _ in part])
                    sent += list(zip(([2 * a + b for a, b in h.tolist()] if wide else h.tolist()), d.tolist(), s.tolist(), strict=True))
        least, most = {}, {}
        for v, d, s in sent:
            if not s:
                least[v], most[v] = min(d, least.get(v, d)), max(d, most.get(v, d))
        told = {(v, d) for v, d, s in sent if s or (least[v] < most[v] if settle_all else d > least[v])}
        want = {(v, d) for v, ds in holders.items() for d in ds if (len(ds) > 1 if settle_all else d > min(ds))}
        assert told == want
