"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A window is n
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Each document's words
are numbered by the benchmark's vocabulary, windows of numbers are hashed with a rolling polynomial and looked up in the
sorted hashes of the benchmark; every hit is then verified word by word, so that a collision of hashes changes nothing.

The hash set holds the benchmark, never the documents. It is broadcast in blocks of at most BLOCK_WINDOWS windows (an
item of more is cut into pieces that share the words between them). A benchmark beyond one block is scanned block by
block: the documents are stored with a number for each row, each block's hits are stored before the next block is made,
and they meet under the row's number. So neither a broadcast nor the driver grows with the input, and what a row gets
does not depend on the number of blocks, whatever its key.

Null or empty texts have no words: they get zeros, no items, and are not contaminated. An empty benchmark hits nothing.
Equal items count as items of their own. The windows of an item with a null item_id hit words like any other's; only the
list of items leaves it out, since there is no id to give. Repeated rows each get their hits. A very long text needs memory for its words and eight bytes a word. Other columns pass unchanged; find_hits replaces
columns named as its outputs, the filters keep all of the caller's columns.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import add_columns, arrow_map, spare, stored

#: Windows in one broadcast: some 60 MB in a task at most.
BLOCK_WINDOWS = 500_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words, as UTF-8. All white space is ASCII, so bytes can be cut safely."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of so many values (uint64): windows of 1, 2, 4, ... values joined as length's bits ask."""
    count = len(values) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    found = np.zeros(count, np.uint64)
    part, size, power, done = values, 1, _MULTIPLIER, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                found = found * power + part[done : done + count]
                done += size
            if 2 * size > length:
                return found
            part = part[:-size] * power + part[size:]
            power = power * power
            size *= 2


class Windows:
    """A block of the benchmark's windows, ready to scan."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        """items: (item id as text, words). An item without an id hits words, but is not listed."""
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1):
                by_length[size][tuple(ids[at : at + size])].add(item)
        # A number's code is a fixed random-like value, so that windows of small numbers spread.
        with np.errstate(over="ignore"):
            mixed = (np.arange(len(self.vocabulary) + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            self.codes = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.by_length = []
        for size, windows in sorted(by_length.items()):
            keys = list(windows)
            hashes = rolling(self.codes[np.array(keys, dtype=np.int64).reshape(-1)], size)[::size]
            self.by_length.append((size, np.sort(hashes), {k: sorted(v - {None}) for k, v in windows.items()}))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Whether each word lies in a benchmark window, and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        if not words or not self.vocabulary:
            return hit, items
        known = self.vocabulary.get
        ids = np.fromiter([known(w, 0) for w in words], np.int64, len(words))
        found = ids > 0
        if not found.any():
            return hit, items
        codes = self.codes[ids]
        run = np.concatenate(([0], np.cumsum(found)))
        for size, hashes, windows in self.by_length:
            if len(words) < size:
                continue
            full = np.flatnonzero(run[size:] - run[:-size] == size)  # all words known to the benchmark
            if not len(full):
                continue
            own = rolling(codes, size)[full]
            at = np.searchsorted(hashes, own)
            at[at == len(hashes)] = 0
            for start in full[hashes[at] == own].tolist():
                if (who := windows.get(tuple(ids[start : start + size].tolist()))) is not None:
                    hit[start : start + size] = True
                    items.update(who)
        return hit, items


def _blocks(benchmark: DataFrame, item: str, text: str, n: int, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark's items, in blocks of a bounded number of windows, one partition at a time on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        windows = max(1, len(words) - n + 1) if words else 0
        for first in range(0, windows, most):
            held = min(most, windows - first)
            if block and size + held > most:
                yield block
                block, size = [], 0
            block.append((row["item"], words[first : first + held + n - 1]))
            size += held
    if block:
        yield block


OUTPUTS = ("n_words", "hit_words", "hit_items")


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", benchmark_text: str = "text", block_windows: int = BLOCK_WINDOWS, names: tuple[str, str, str] = OUTPUTS) -> DataFrame:
    """Documents with n_words, hit_words (the numbers of hit words, ascending) and hit_items (ids as text, sorted), or with
    columns of the names given."""
    spark = documents.sparkSession
    n_words, hit_words, hit_items = names
    kinds = [(n_words, T.LongType(), pa.int64()), (hit_words, T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), (hit_items, T.ArrayType(T.StringType()), pa.list_(pa.string()))]

    def scanned(rows: DataFrame, block: list[tuple[str | None, list[bytes]]]) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(Windows(block, n))

        def make():
            windows = sent.value

            def step(values: list) -> tuple[list, list, list]:
                sizes, places, items = [], [], []
                for value in values:
                    words = words_of(value)
                    hit, who = windows.scan(words)
                    sizes.append(len(words))
                    places.append(np.flatnonzero(hit).astype(np.int32))
                    items.append(sorted(who))
                return sizes, places, items

            return step

        return add_columns(rows, make, text, kinds), sent

    blocks = _blocks(benchmark, item, benchmark_text, n, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return scanned(documents, first)[0]
    number, others = spare([*documents.columns, *names], "row"), [c for c in documents.columns if c not in names]
    numbered = stored(documents.withColumn(number, F.monotonically_increasing_id()), "decontam-rows")
    slim = numbered.select(number, text)
    passes: list[DataFrame] = []
    for block in itertools.chain([first, second], blocks):
        found, sent = scanned(slim, block)
        # The first pass brings every row, later ones what they hit.
        passes.append(stored(found.select(number, *names) if not passes else found.select(number, *names).where(F.size(hit_words) > 0), "decontam-hits"))
        sent.unpersist()
    told = functools.reduce(DataFrame.unionByName, passes)
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    told = told.groupBy(number).agg(F.first(n_words).alias(n_words), distinct(hit_words), distinct(hit_items))
    return numbered.select(number, *others).join(told, number).select(*others, *names)


def report(hits: DataFrame) -> DataFrame:
    """Counts and the digest of the items in place of places and items."""
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def _own_names(documents: DataFrame) -> tuple[str, str, str]:
    return tuple(spare(documents.columns, name) for name in OUTPUTS)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10, most_share: float = 0.0, text: str = "text", **finding) -> DataFrame:
    """Only the documents whose share of hit words is at most most_share, with their own columns."""
    names = _own_names(documents)
    hits = find_hits(documents, benchmark, n, text, names=names, **finding)
    return hits.where(F.size(names[1]) <= most_share * F.col(names[0])).select(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", cut_with: str = " ", **finding) -> DataFrame:
    """Texts without their hit words: each run of hit words, and what stands between them, becomes one cut_with."""
    own = _own_names(documents)
    hits = find_hits(documents, benchmark, n, text, names=own, **finding)

    def make():
        import re

        word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

        def cut(value: str, places: set[int]) -> str:
            out, last, removing = [], 0, False
            for at, m in enumerate(word.finditer(value)):
                if at in places:
                    if not removing:
                        out += [value[last : m.start()], cut_with]
                    last, removing = m.end(), True
                elif removing:
                    removing = False
            return "".join([*out, value[last:]])

        return lambda texts, places: [cut(t, set(p)) if p else t for t, p in zip(texts, places, strict=True)]

    names = documents.columns

    def build():
        step = make()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = step(batch.column(text).to_pylist(), batch.column(own[1]).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

        return one

    return arrow_map(hits.select(*names, own[1]), build, documents.schema, text)


def items_digest(items: list[str]) -> str:
    """The digest that report() gives, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
