"""Phrase collocation mining: word sequences that occur together more often than their parts suggest.

Texts are cut at punctuation and line ends into pieces, of which equal ones become one row with a multiplicity. Phrases
are then counted level by level, from one word to `most_words`. On a level each task cuts its pieces into windows, merges
equal ones of some megabytes of text, and sends (phrase, count) to the phrase's hash bucket, where DuckDB sums them out of
core: what exceeds its memory goes to a scratch folder that ends with the task. Counts below `least` leave there; no score
needs them, since a part of a phrase is at least as frequent as the phrase.

For the same reason a window is only sent on if both windows of one word less that it holds are frequent. Tasks know the
frequent phrases of the level before as a Bloom filter of a fixed number of bits, which is broadcast. It has no false
negatives, and false positives only cost work; when there are too many phrases for it, it lets more pass, no matter what.

The counts of a phrase's parts are looked up by requests: each cut of a phrase sends one for its first and one for its
last part to the place of the part's count, and the answers come back to the phrase. Single words get the most requests, so
counts are held in several copies, by the number of words, and a request picks one by its phrase's hash. These joins ask
for sorted shuffles: Spark takes a side's size before its copies, cuts and parts, and would else send it through the
driver as a broadcast. Arithmetic is in decimals of 38 digits and exact; counts whose products exceed that raise an error.

A null language is `und`; it meets rows that say so. Null or empty texts have no words, an empty table gives no rows,
repeated rows count each, and equal scores are ordered by count and phrase. A very long text is cut into its pieces by
Spark; a piece is held whole in a task. Other columns are not read.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import prepare_arrow, stored
from cuetide.llm.decontam import rolling

MOST_WORDS, LEAST, MOST_RANK, HELD_BY = 5, 100, 2000, 100
#: Text that a task merges at once, bits of a filter, and DuckDB's memory in a bucket.
CHUNK_BYTES, FILTER_BITS, BUCKET_MEMORY = 8 << 20, 1 << 27, "256MB"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUTS = ".,;:!?\x0b\x0c\r"
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_COUNTED_SQL = "lang string, phrase string, f long"


@dataclass
class Counts:
    """phrases: lang, phrase, size, f, frequent ones of all sizes. totals: lang, n, of all words."""

    phrases: DataFrame
    totals: DataFrame


def pieces(documents: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, piece, n): distinct pieces with words, lower-cased, tabs made spaces, and how often they occur."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _CUTS + "\t", _LOWER + "\n" * len(_CUTS) + " ")
    cut = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(plain, "\n", -1)).alias("piece"))
    return cut.select("lang", F.trim("piece").alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False)


def _slots(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's places for each hash."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        for k in range(4):
            yield (mixed + np.uint64(k) * step) & np.uint64(bits - 1)


def _phrase_filter(phrases: DataFrame, size: int, bits: int) -> np.ndarray:
    """Bloom filter of phrases of one size, as 64-bit words. Words with bits set come to the driver, at most bits / 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase"), " ").flatten()
            own = rolling(_hashes(words), size)[::size] ^ _hashes(batch.column("lang"))
            for at in _slots(own, bits):
                np.bitwise_or.at(found, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at].view(np.int64))], names=["at", "bits"])

    told = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(bits // 64, np.uint64)
    whole[told.column("at").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    return whole


def _passes(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for at in _slots(hashes, len(whole) * 64):
        ok &= (whole[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return ok


def windows(table: pa.Table, size: int, whole: np.ndarray | None) -> pa.RecordBatch:
    """Distinct phrases of so many words in a chunk of pieces (lang, piece, n) whose shorter windows pass the filter, with
    their weighted counts."""
    split = pc.split_pattern(table.column("piece").combine_chunks(), " ")
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    owner = owner.filter(real).to_numpy()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    ids, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lang = langs.indices.to_numpy()[owner].astype(np.int64)
    start = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if len(owner) >= size else np.empty(0, np.int64)
    if whole is not None and len(start):
        mixed = rolling(_hashes(words)[ids], size - 1)
        mixed ^= _hashes(langs.dictionary)[lang[: len(mixed)]]
        ok = _passes(whole, mixed)
        start = start[ok[start] & ok[start + 1]]
    # Windows as numbers: pairs are made dense again before they could pass 63 bits.
    number, reach = lang[start], max(1, len(langs.dictionary))
    for k in range(size):
        if reach * len(words) >= 1 << 62:
            number = np.unique(number, return_inverse=True)[1]
            reach = len(number) + 1
        number, reach = number * len(words) + ids[start + k], reach * max(1, len(words))
    _, first, place = np.unique(number, return_index=True, return_inverse=True)
    counts = np.zeros(len(first), np.int64)
    np.add.at(counts, place, table.column("n").to_numpy()[owner[start]])
    at = start[first]
    phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at + k])) for k in range(size)], " ")
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at])), phrase, pa.array(counts)], schema=_COUNTED)


def _windows_of_tasks(rows: DataFrame, size: int, sent, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            found = windows(pa.Table.from_batches(held), size, None if sent is None else sent.value)
            for at in range(0, found.num_rows, 20_000):
                yield found.slice(at, 20_000)

        for batch in batches:
            held.append(batch)
            total += batch.column("piece").nbytes
            if total >= chunk_bytes:
                yield from merged()
                held, total = [], 0
        if held:
            yield from merged()

    return rows.mapInArrow(run, _COUNTED_SQL)


def _summed_in_duckdb(rows: DataFrame, least: int, memory: str) -> DataFrame:
    """Sums per phrase, by hash bucket; only those that reach least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory(prefix="cuetide-bucket-") as scratch:
            with duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False}) as db:
                bucket = pa.RecordBatchReader.from_batches(_COUNTED, (b.cast(_COUNTED) for b in batches))
                db.register("bucket", bucket)
                found = db.sql(f"select lang, phrase, sum(f)::bigint as f from bucket group by all having sum(f) >= {int(least)}")
                for batch in found.to_arrow_reader(20_000):
                    yield batch.cast(_COUNTED)

    return rows.repartition("lang", "phrase").mapInArrow(run, _COUNTED_SQL)


def count_phrases(documents: DataFrame, lang: str = "lang", text: str = "text", most_words: int = MOST_WORDS, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES, filter_bits: int = FILTER_BITS, memory: str = BUCKET_MEMORY) -> Counts:
    """Exact counts of all phrases that occur at least so often, and of all words, per language."""
    spark = documents.sparkSession
    prepare_arrow(spark)
    rows = stored(pieces(documents, lang, text), "pieces")
    totals = rows.groupBy("lang").agg(F.sum(F.col("n") * F.size(F.array_remove(F.split("piece", " "), ""))).alias("n"))
    levels, sent = [], None
    for size in range(1, most_words + 1):
        level = stored(_summed_in_duckdb(_windows_of_tasks(rows, size, sent, chunk_bytes), least, memory).withColumn("size", F.lit(size)), f"phrases-{size}")
        if sent is not None:
            sent.unpersist()
        levels.append(level)
        if level.isEmpty():
            break
        if size < most_words:
            sent = spark.sparkContext.broadcast(_phrase_filter(level, size, filter_bits))
    return Counts(functools.reduce(DataFrame.unionByName, levels), stored(totals, "words"))


def _words(c: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(c, first, count), " ")


def score(counts: Counts, most_words: int = MOST_WORDS, held_by: int = HELD_BY) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of two words and more, but for those that a longer one holds with at
    least held_by hundredths of their count. score is a thousand times the count over what chance would give, at the
    worst cut."""
    phrases = counts.phrases.withColumn("w", F.split("phrase", " "))
    long = phrases.where("size >= 2")

    # Requests and answers; single words have 4 ** (most_words - 2) copies, each word more a quarter.
    copies = lambda size: F.pow(F.lit(4), F.greatest(F.lit(0), F.lit(most_words - 1) - size)).cast("int")
    k = F.col("k")
    cuts = long.select("lang", "phrase", "size", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), k.alias("words"), _words(F.col("w"), F.lit(1), k).alias("part")), F.struct(F.lit(1).alias("side"), (F.col("size") - k).alias("words"), _words(F.col("w"), k + 1, F.col("size") - k).alias("part"))))
    requests = cuts.select("lang", "phrase", "a", "k", sides.alias("x")).select("lang", "phrase", "a", "k", "x.side", "x.part", F.pmod(F.xxhash64("phrase", "k"), copies(F.col("x.words"))).cast("int").alias("copy"))
    held = phrases.where(F.col("size") < most_words).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), "f", F.explode(F.sequence(F.lit(0), copies(F.col("size")) - 1)).alias("_copy"))
    answers = requests.hint("merge").join(held.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_part")) & (F.col("copy") == F.col("_copy")))
    sizes = range(1, most_words)
    told = answers.groupBy("lang", "phrase", "a").agg(*[F.max(F.when((k == i) & (F.col("side") == side), F.col("f"))).alias(f"{name}{i}") for i in sizes for side, name in ((0, "l"), (1, "r"))])
    placed = told.join(counts.totals.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"))
    whole = lambda c: f"cast({c} as decimal(20,0))"
    cut_scores = [F.when(F.col(f"l{i}").isNotNull(), F.struct(F.expr(f"(cast(1000 as decimal(4,0)) * ({whole('a')} * {whole('n')})) div ({whole(f'l{i}')} * {whole(f'r{i}')})").alias("score"), F.lit(i).alias("k"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r"))) for i in sizes]
    worst = F.least(*cut_scores) if len(cut_scores) > 1 else cut_scores[0]
    scored = placed.select("lang", "phrase", "a", "n", worst.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice(F.col("w"), i, s), " "))))
    longer = long.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_inner")).agg(F.max("f").alias("_f"))
    both = scored.join(longer.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_inner")), "left")
    return both.where(F.col("_f").isNull() | (F.col("_f") * 100 < F.col("a") * held_by)).drop("_lang", "_inner", "_f")


def top_phrases(scored: DataFrame, most: int = MOST_RANK, parts: int = 64) -> DataFrame:
    """The first of each language with their rank. Ranks are taken in parts of a language first, so that what one task
    ranks in the end is bounded."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
