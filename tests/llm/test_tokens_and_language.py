"""BPE against the tokenizers library; language ID against its held-out fold."""

import hashlib
import random

import numpy as np
import pytest

from cuetide.llm import bpe, langid, queries

ODD = ["", " ", "ΑΣ ΣΑΣ Σ", "a<|endoftext|>b <|startoftext|> <|x|>", "aaaaaaaaaaaaaaaaaaa don't İ ẞ é é", "漢字かな 한국어 😀😀 \x00\x1c\x1d a\x85b\xa0c d　e 12345 ½ ² Ⅷ", "x" * 5000, "!?" * 3000, "".join(map(chr, range(32, 0x2500))), "\u1c89\ua7cb \U00010d50"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_equals_the_library(library):
    spec = bpe.load_spec(queries.tokenizer_path())
    model, decoder, rnd = bpe.WordBPE(spec), bpe.Decoder(spec), random.Random(1)
    rows = ODD + ["".join(rnd.choice("abcdeinthg 'sé1") for _ in range(200)) for _ in range(100)]
    for text, want in zip(rows, library.encode_batch(rows, add_special_tokens=False), strict=True):
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert decoder.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_small_caches_change_nothing(library, monkeypatch, texts):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 10)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 300)
    model = bpe.WordBPE(bpe.load_spec(queries.tokenizer_path()))
    for text in list(texts.values())[:30]:
        assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_op1(spark, sf, texts, library):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, sf).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_rows(spark):
    rows = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "", "k")], "doc_id long, text string, token_ids string")
    spec = bpe.load_spec(queries.tokenizer_path())
    got = bpe.with_token_digests(bpe.decode(bpe.encode(rows, spec), spec)).collect()
    assert [r.n_tokens for r in got] == [0, 0, 0] and "token_ids" not in got[0]
    assert bpe.encode(rows.limit(0), spec).count() == 0


def test_language_id_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op2_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and 100 < len(held) < 300
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) == 0


def test_language_id_edge_rows(spark):
    named = [(i, t, lang) for i in range(60) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    table = spark.createDataFrame([(2 * i + j, t, lang) for i, (n, t, lang) in enumerate(named) for j in (0,)], "doc_id long, text string, lang string")
    model = langid.train(table)
    rows = spark.createDataFrame([(1, None, 9), (2, "12 34 !", 9), (3, "the dog", 9), (4, "und der hund", 9), (5, "漢字" * 40, 9)], "doc_id long, text string, score long")
    got = {r.doc_id: r for r in langid.predict(rows, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "en", "de"]
    assert got[1].score == 0.0 and got[1].rejected and got[5].rejected and not got[3].rejected
    none = langid.train(table.limit(0))
    assert [r.lang_pred for r in langid.predict(rows, none).collect()] == ["und"] * 5


def test_kneser_ney_sums_to_one():
    counts = {"\x02a": 3, "\x02b": 1, "\x02ab": 3, "\x02b\x03": 1, "ab\x03": 2, "aba": 1, "ba\x03": 1}
    other = {"\x02q": 2, "\x02q\x03": 2}
    symbols = sorted({g[-1] for g in [*counts, *other]})  # all that is ever predicted, in either language
    probabilities, backoff, floor = langid._fit_language(counts, 3, len(symbols))

    def p(gram):
        if not gram:
            return floor
        if gram in probabilities[len(gram)]:
            return probabilities[len(gram)][gram]
        return backoff[len(gram)].get(gram[:-1], 1.0) * p(gram[1:]) if len(gram) > 1 else floor

    for context in ("", "\x02", "a", "\x02a", "ab", "b", "zz"):
        assert abs(sum(p(context + c) for c in [*symbols, "?"]) - 1) < 1e-9
    model = langid.fit({"x": counts, "y": other}, 3)
    want = np.log(p("\x02a")) + np.log(p("\x02ab")) + np.log(p("ab\x03"))
    assert abs(model.score_words(["ab"])[0][0, 0] - want) < 1e-5
