"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

A language's model gives each letter of a word, and the word's end, a probability from up to four symbols before it
within the word (its start included). Each language has its own n-grams in a sorted array of 64-bit hashes per order,
beside them their log probabilities; contexts likewise, with their log back-off weights. A text's cross-entropy under a
language is the mean over all its symbols; the lowest wins.

Training takes at most `docs_per_language` labelled rows per language, chosen by a hash of the key, and of these the first
whose characters come to at most `chars_per_language`, and to at most TOTAL_CHARS over all languages in equal shares; a
language's first row is taken whatever its length. Spark counts the n-grams, and each language is fitted on an executor;
the driver and the broadcast hold 12 bytes for each n-gram that a language's own sample has, so they grow with the sample
bound, not with the number of pairs of n-grams and languages. A fifth of the sample is kept out of the counts to calibrate:
the temperature of the score (the winner's share under softmax of the cross-entropies), and the threshold above which a
text fits no language. That threshold lies beyond every calibration text's distance from its language's mean, in units
that shrink with the text's length, by a factor, and leaves texts at least SLACK nats of room.

Null texts and texts without letters: `und`, score 0, rejected. No labelled rows at all: every text is `und`, and none is
rejected, since only a fitted model can tell. Ties go to the language that sorts first. Repeated rows are judged alike;
empty tables give none. Every label is learned; more than MOST_LANGUAGES raise an error, as they are hardly languages.
Other columns pass unchanged; predict replaces columns named as its outputs, keep_recognised keeps all of the caller's.
A long text is scored in blocks of BLOCK symbols, with some 20 bytes a letter beside it for its longest run of letters.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import add_columns, let_go, ship, spare, stored

ORDER = 5
DOCS_PER_LANGUAGE = 400
#: Characters of the sample, per language and together.
CHARS_PER_LANGUAGE, TOTAL_CHARS = 8_000_000, 64_000_000
MOST_LANGUAGES = 1000
#: Calibration: the room given beyond the furthest calibration text.
FACTOR, SLACK = 1.5, 0.5
UNDETERMINED = "und"
_START, _END = "\x02", "\x03"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct text pieces whose scores a task keeps, numbers that these may be, and symbols scored at once.
_CACHE, _CACHED_NUMBERS = 100_000, 8_000_000
#: Temperatures that are tried.
_GRID = np.geomspace(0.5, 200, 40)
BLOCK = 1 << 17


def words_of(chunk: str) -> list[str]:
    """Runs of letters, lower case, composed."""
    chunk = unicodedata.normalize("NFC", chunk).lower()
    if chunk.isalpha():
        return [chunk]
    return "".join(c if c.isalpha() else " " for c in chunk).split()


def _hashes(codes: np.ndarray, place: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order 1.. most: hashes of the n-grams that end at each symbol, and whether the word has that many."""
    out, total, power = [], np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for order in range(1, most + 1):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[order - 1 :] = codes[: len(codes) - order + 1]
            total = total + (shifted + np.uint64(1)) * power
            power = power * _BASE
            mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed ^ (mixed >> np.uint64(32)), place >= order - 1))
    return out


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their start and end marks, and each one's place in its word."""
    joined = "".join([_START + w + _END for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes)


def _gram_hashes(grams: list[str]) -> np.ndarray:
    """The hash of each whole gram; all are of one length."""
    if not grams:
        return np.empty(0, np.uint64)
    size = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _hashes(codes, np.tile(np.arange(size), len(grams)), size)[-1][0][size - 1 :: size]


Table = tuple[np.ndarray, np.ndarray]


#: Per order: the different hashes of n-grams, sorted, which of them each symbol has, and whether its word has that many.
Hashed = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _lookup(table: Table, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted hashes a sorted array has, and a value for each, which counts where it has it. Wanted hashes are
    sorted too, which makes the search fast."""
    hashes, values = table
    if not len(hashes):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
    at = np.searchsorted(hashes, wanted)
    at[at == len(hashes)] = 0
    return hashes[at] == wanted, values[at]


@dataclass
class LanguageModel:
    grams: list[Table]  # per order: sorted hashes, log probabilities
    contexts: list[Table]  # per order of the n-gram: sorted hashes, log back-off weights
    floor: float  # log probability of an unknown symbol

    def score(self, hashed: Hashed, predicted: np.ndarray) -> np.ndarray:
        """The log probability of each symbol that is predicted, else 0."""
        total, todo = np.zeros(len(predicted), np.float32), np.flatnonzero(predicted)
        for order in range(len(self.grams), 0, -1):
            wanted, which, fits = hashed[order - 1]
            # A block's first symbols lack their context; they are not asked for.
            able = fits[todo] & (todo >= order - 1)
            asked, later = todo[able], todo[~able]
            known, values = _lookup(self.grams[order - 1], wanted)
            own = which[asked]
            hit = known[own]
            total[asked[hit]] += values[own[hit]]
            missed = asked[~hit]
            if order > 1 and len(missed):
                wanted, which, _ = hashed[order - 2]
                known, weights = _lookup(self.contexts[order - 1], wanted)
                own = which[missed - 1]
                hit = known[own]
                total[missed[hit]] += weights[own[hit]]
            todo = np.concatenate((missed, later))
        total[todo] += self.floor
        return total


@dataclass
class Model:
    languages: list[str]
    fitted: list[LanguageModel]
    temperature: float = 1.0
    center: np.ndarray | None = None  # per language: mean cross-entropy of calibration texts
    reach: np.ndarray | None = None  # per language: furthest (cross-entropy - mean) * sqrt(words)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities per language, symbols) of each word."""
        sums, sizes = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        if not words:
            return sums, sizes
        codes, place = _symbols(words)
        owner = np.cumsum(place == 0) - 1
        before = max((len(m.grams) for m in self.fitted), default=0)
        for first in range(0, len(codes), BLOCK):
            # A block brings the symbols before it along as context.
            start, last = max(0, first - before), min(first + BLOCK, len(codes))
            hashed = [(*np.unique(h, return_inverse=True), fits) for h, fits in _hashes(codes[start:last], place[start:last], before)]
            predicted = place[start:last] > 0  # the start mark is given, not predicted
            own = owner[first:last]
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            for at, language in enumerate(self.fitted):
                total = language.score(hashed, predicted)[first - start :]
                sums[own[edges], at] += np.add.reduceat(total, edges, dtype=np.float64)
            sizes[own[edges]] += np.add.reduceat(predicted[first - start :], edges, dtype=np.int64)
        return sums, sizes


def _fit_language(counts: dict[str, int], order: int, symbols: int):
    """Interpolated Kneser-Ney: (probabilities by order, back-off weights by order, floor), keyed by strings."""
    by_order: list[dict[str, int]] = [{} for _ in range(order + 1)]
    for gram, n in counts.items():
        by_order[len(gram)][gram] = by_order[len(gram)].get(gram, 0) + n
    # Below the highest order, a gram counts the different symbols before it; one at a word's start has its own count.
    for size in range(order - 1, 0, -1):
        for gram in by_order[size + 1]:
            if gram[1:] != _START:
                by_order[size][gram[1:]] = by_order[size].get(gram[1:], 0) + 1
    probabilities: list[dict[str, float]] = [{} for _ in range(order + 1)]
    backoff: list[dict[str, float]] = [{} for _ in range(order + 1)]
    floor = 1.0 / (symbols + 1)
    for size in range(1, order + 1):
        grams = by_order[size]
        ones, twos = sum(n == 1 for n in grams.values()), sum(n == 2 for n in grams.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        totals, kinds = defaultdict(int), defaultdict(int)
        for gram, n in grams.items():
            totals[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        for context, total in totals.items():
            backoff[size][context] = discount * kinds[context] / total
        for gram, n in grams.items():
            lower = probabilities[size - 1].get(gram[1:], floor) if size > 1 else 1.0 / (symbols + 1)
            probabilities[size][gram] = max(n - discount, 0) / totals[gram[:-1]] + backoff[size][gram[:-1]] * lower
        if size == 1:
            floor = backoff[1].get("", 1.0) / (symbols + 1)
    return probabilities, backoff, floor


def _table(values: dict[str, float]) -> Table:
    hashes = _gram_hashes(list(values))
    by_hash = np.argsort(hashes)
    return hashes[by_hash], np.log(np.fromiter(values.values(), np.float64, len(values))).astype(np.float32)[by_hash]


def fit_language(counts: dict[str, int], order: int, symbols: int) -> LanguageModel:
    """counts: n-gram counts of one language, each n-gram the longest that ends at a symbol; symbols: how many different
    ones any language can predict."""
    probabilities, backoff, floor = _fit_language(counts, order, symbols)
    contexts = [_table(backoff[size] if size > 1 else {}) for size in range(1, order + 1)]
    return LanguageModel([_table(probabilities[size]) for size in range(1, order + 1)], contexts, float(np.log(floor)))


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """A model of counts that are here, per language; train() counts and fits on the executors."""
    languages = sorted(counts)
    symbols = len({g[-1] for grams in counts.values() for g in grams})  # what can be predicted: not the start mark
    return Model(languages, [fit_language(counts[lang], order, symbols) for lang in languages])


class Scorer:
    """Cross-entropies of whole texts; distinct pieces between white space are scored once per slice."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.sums = np.zeros((0, len(model.languages)))
        self.sizes = np.zeros(0, np.int64)
        self.words = np.zeros(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        words, owner = [], []
        for at, chunk in enumerate(fresh):
            own = words_of(chunk)
            words += own
            owner += [at] * len(own)
        sums, sizes = self.model.score_words(words)
        more = np.zeros((len(fresh), len(self.model.languages)))
        np.add.at(more, owner, sums)
        first = len(self.index)
        self.index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        self.sums = np.concatenate((self.sums, more))
        self.sizes = np.concatenate((self.sizes, np.bincount(owner, sizes, len(fresh)).astype(np.int64)))
        self.words = np.concatenate((self.words, np.bincount(owner, minlength=len(fresh)).astype(np.int64)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probabilities per language, symbols, words) of each text."""
        chunks = [(t or "").split() for t in texts]
        seen = {c for own in chunks for c in own}
        fresh = [c for c in seen if c not in self.index]
        if len(self.index) + len(fresh) > min(_CACHE, _CACHED_NUMBERS // max(1, len(self.model.languages))):
            self.__init__(self.model)
            fresh = list(seen)
        if fresh:
            self._learn(fresh)
        count = len(self.model.languages)
        sums, sizes, words = np.zeros((len(texts), count)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        index = self.index
        for at, own in enumerate(chunks):
            if own:
                rows = np.fromiter([index[c] for c in own], np.int64, len(own))
                sums[at], sizes[at], words[at] = self.sums[rows].sum(0), self.sizes[rows].sum(), self.words[rows].sum()
        return sums, sizes, words


def _losses(entropy: np.ndarray, own: int) -> list[float]:
    """What a text's label costs at each temperature of the grid."""
    logits = -(entropy - entropy.min())[None, :] * _GRID[:, None]
    return (np.log(np.exp(logits).sum(1)) - logits[:, own]).tolist()


def _calibrate(model: Model, told: list) -> None:
    """Set temperature, center and reach from labelled texts that the counts don't hold: each one's language (its place),
    cross-entropy under it, number of words, and losses."""
    count = len(model.languages)
    model.center, model.reach = np.full(count, np.inf), np.zeros(count)
    own = np.array([r["place"] for r in told], np.int64)
    entropy, words = np.array([r["entropy"] for r in told], np.float64), np.array([r["words"] for r in told], np.int64)
    for at in range(count):
        mine = entropy[own == at]
        if len(mine):
            model.center[at] = np.average(mine, weights=words[own == at])
            model.reach[at] = np.max((mine - model.center[at]) * np.sqrt(words[own == at]), initial=0.0)
    if told and count > 1:
        model.temperature = float(_GRID[int(np.argmin(np.mean([r["losses"] for r in told], axis=0)))])


def held_out(key: Column) -> Column:
    """The fold that no training sees."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(labelled: DataFrame, sizes: dict[str, int], docs: int, chars: int) -> DataFrame:
    """(lang, text, nth) of the rows to learn from, at most so many rows and characters of each language."""
    # A hash below the language's share takes about a quarter more rows than wanted, of which the first ones stay.
    lot = F.pmod(F.xxhash64(F.col("key"), F.lit("langid")), F.lit(1 << 32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 32, int((1 << 32) * 1.25 * (docs + 20) / n)))])
    drawn = labelled.where(lot < F.element_at(share, F.col("lang"))).select("lang", "text", lot.alias("lot"))
    order = Window.partitionBy("lang").orderBy("lot", "text")
    placed = drawn.withColumns({"nth": F.row_number().over(order), "sum": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.where((F.col("nth") <= docs) & ((F.col("sum") <= chars) | (F.col("nth") == 1))).select("lang", "text", "nth")


def _counted(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n)."""

    def count(frames):
        for frame in frames:
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, value in zip(frame["lang"], frame["text"], strict=True):
                for chunk, n in Counter(value.split()).items():
                    for word in words_of(chunk):
                        marked = _START + word + _END
                        for end in range(2, len(marked) + 1):
                            found[lang][marked[max(0, end - order) : end]] += n
            yield pd.DataFrame([(lang, g, n) for lang, grams in found.items() for g, n in grams.items()], columns=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _fit_on_executors(counts: DataFrame, order: int) -> Model:
    """A language is a group, whose n-grams the sample bounds."""
    symbols = counts.select(F.substring("gram", -1, 1).alias("symbol")).distinct().count()

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = fit_language(dict(zip(frame["gram"].tolist(), frame["n"].tolist(), strict=True)), order, symbols)
        packed = [x.tobytes() for tables in (found.grams, found.contexts) for table in tables for x in table]
        return pd.DataFrame({"lang": [key[0]], "floor": [found.floor], "packed": [packed]})

    rows = counts.groupBy("lang").applyInPandas(one, "lang string, floor double, packed array<binary>").orderBy("lang").collect()
    # An order's hashes and values stand beside each other, n-grams before contexts.
    table = lambda packed, at: (np.frombuffer(packed[2 * at], np.uint64), np.frombuffer(packed[2 * at + 1], np.float32))
    fitted = [LanguageModel([table(r["packed"], k) for k in range(order)], [table(r["packed"], order + k) for k in range(order)], r["floor"]) for r in rows]
    return Model([r["lang"] for r in rows], fitted)


def train(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER, chars_per_language: int = CHARS_PER_LANGUAGE) -> Model:
    """Fit on df's rows with a label and a text, those of the held-out fold excepted."""
    spark = df.sparkSession
    ship(spark)
    usable = df.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    labelled = usable.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    # One more than allowed, to tell that there are too many.
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels")
    if not sizes:
        return Model([], [])
    sample = stored(_sample(labelled, sizes, docs_per_language, min(chars_per_language, TOTAL_CHARS // len(sizes))), "langid-sample")
    counts = stored(_counted(sample.where("nth % 5 != 0"), order), "langid-counts")
    model = _fit_on_executors(counts, order)
    if model.languages:
        # The texts stay on the executors; a row of numbers for each comes here.
        sent = spark.sparkContext.broadcast(model)

        def score(frames):
            place, scorer = {lang: at for at, lang in enumerate(sent.value.languages)}, Scorer(sent.value)
            for frame in frames:
                for lang, value in zip(frame["lang"], frame["text"], strict=True):
                    sums, sizes, words = scorer([value])
                    if sizes[0] and lang in place:
                        entropy, own = -sums[0] / sizes[0], place[lang]
                        yield pd.DataFrame({"place": [own], "entropy": [entropy[own]], "words": [int(words[0])], "losses": [_losses(entropy, own)]})

        _calibrate(model, sample.where("nth % 5 = 0").select("lang", "text").mapInPandas(score, "place long, entropy double, words long, losses array<double>").collect())
        sent.unpersist()
    let_go(sample, counts)
    return model


OUTPUTS = ("lang_pred", "score", "rejected", "cross_entropy")


def keep_recognised(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without the rows that predict() rejects, with its own columns. A model of no language rejects none."""
    names = tuple(spare(df.columns, name) for name in OUTPUTS)
    return predict(df, model, text, names).where(~F.col(names[2])).select(*df.columns)


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str, str] = OUTPUTS) -> DataFrame:
    """Add lang_pred, score (0 to 1), rejected and cross_entropy (nats a symbol), or columns of the names given."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        scorer = Scorer(model)
        count = len(model.languages)

        def step(values: list) -> tuple[list, ...]:
            if not count:
                return [UNDETERMINED] * len(values), [0.0] * len(values), [False] * len(values), [None] * len(values)
            sums, sizes, words = scorer(values)
            entropy = -sums / np.maximum(sizes, 1)[:, None]
            best = entropy.argmin(1)
            low = entropy[np.arange(len(best)), best]
            share = 1 / np.exp(-(entropy - low[:, None]) * model.temperature).sum(1)
            limit = model.center[best] + np.maximum(SLACK, FACTOR * model.reach[best] / np.sqrt(np.maximum(words, 1)))
            empty = sizes == 0
            return (
                [UNDETERMINED if e else model.languages[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)],
                np.where(empty, 0.0, share).tolist(),
                (empty | (low > limit)).tolist(),
                [None if e else v for v, e in zip(low.tolist(), empty.tolist(), strict=True)],
            )

        return step

    kinds = [(T.StringType(), pa.string()), (T.DoubleType(), pa.float64()), (T.BooleanType(), pa.bool_()), (T.DoubleType(), pa.float64())]
    return add_columns(df, make, text, [(name, *kind) for name, kind in zip(names, kinds, strict=True)])
