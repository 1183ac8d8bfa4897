"""The query's predictions against a plain Kneser-Ney model: dictionaries, and the formula as it is written."""

import math
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from cuetide.llm import langid, queries

ORDER = langid.ORDER


def grams_of(text):
    for chunk in (text or "").split():
        for word in langid.words_of(chunk):
            marked = "\x02" + word + "\x03"
            for end in range(2, len(marked) + 1):
                yield marked[max(0, end - ORDER) : end]


def plain_model(texts, alphabet):
    counts = [Counter() for _ in range(ORDER + 1)]
    for text in texts:
        for gram in grams_of(text):
            counts[len(gram)][gram] += 1
    for size in range(ORDER - 1, 0, -1):
        before = defaultdict(set)
        for gram in counts[size + 1]:
            if gram[1:] != "\x02":
                before[gram[1:]].add(gram[0])
        for gram, symbols in before.items():
            counts[size][gram] += len(symbols)
    discounts, totals, kinds = {}, defaultdict(int), defaultdict(int)
    for size in range(1, ORDER + 1):
        ones, twos = (sum(n == m for n in counts[size].values()) for m in (1, 2))
        discounts[size] = ones / (ones + 2 * twos) if ones and twos else 0.5
        for gram, n in counts[size].items():
            totals[size, gram[:-1]] += n
            kinds[size, gram[:-1]] += 1

    @cache
    def p(gram):
        if not gram:
            return 1 / (alphabet + 1)
        size, context = len(gram), gram[:-1]
        if not totals[size, context]:
            return p(gram[1:])
        own = max(counts[size][gram] - discounts[size], 0) / totals[size, context]
        return own + discounts[size] * kinds[size, context] / totals[size, context] * p(gram[1:])

    return p


def test_op2_equals_the_plain_model(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    lot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 32))
    rows = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~langid.held_out(F.col("doc_id"))).select("doc_id", "lang", lot.alias("lot")).collect()
    by_language = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.lot, texts[r.doc_id])):
        by_language[r.lang].append(texts[r.doc_id])
    # Every fifth text calibrates; the tables here are smaller than the sample's bound.
    assert all(len(own) <= langid.DOCS_PER_LANGUAGE for own in by_language.values())
    counted = {lang: [t for n, t in enumerate(own, 1) if n % 5] for lang, own in by_language.items()}
    alphabet = len({g[-1] for own in counted.values() for t in own for g in grams_of(t)})
    models = {lang: plain_model(own, alphabet) for lang, own in sorted(counted.items())}
    for doc, text in texts.items():
        grams = Counter(grams_of(text))
        if not grams:
            assert got[doc].lang_pred == "und"
            continue
        entropy = {lang: -sum(n * math.log(p(g)) for g, n in grams.items()) / grams.total() for lang, p in models.items()}
        ranked = sorted(entropy.values())
        if len(ranked) < 2 or ranked[1] - ranked[0] > 1e-4:
            assert got[doc].lang_pred == min(entropy, key=entropy.get), (doc, entropy)


def test_cross_entropies_equal_the_plain_model(spark, texts):
    some = [t for t in texts.values() if t][:60]
    counts = {name: dict(Counter(g for t in own for g in grams_of(t))) for name, own in (("a", some[:30]), ("b", some[30:]))}
    model = langid.fit(counts)
    alphabet = len({g[-1] for grams in counts.values() for g in grams})
    plain = [plain_model(own, alphabet) for own in (some[:30], some[30:])]
    sums, sizes, _ = langid.Scorer(model)(some)
    for at, text in enumerate(some):
        grams = Counter(grams_of(text))
        assert sizes[at] == grams.total()
        for which, p in enumerate(plain):
            want = sum(n * math.log(p(g)) for g, n in grams.items())
            assert sums[at][which] == pytest.approx(want, rel=1e-4, abs=1e-3)
