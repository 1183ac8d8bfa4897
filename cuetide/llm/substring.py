"""Removal of long repeated passages, found by difference-cover anchors.

A passage of at least `length` words (50) that stands in two documents starts at any two places. D is a difference
cover modulo a period v: every difference modulo v is one of two members of D. So among any v consecutive places of the
passage there is one that is in D, modulo v, in both documents. Hashing windows of length - v + 1 words at places in D
alone therefore gives every such pair of passages a shared, aligned anchor, at 6 of 31 places rather than at all.

An anchor whose hash also stands in another document is then extended to the full windows of `length` words that hold
it; each of those is compared whole, and it is a repeat if the smallest document that has it is another, smaller one.
Anchors only say where to look, so 64 bits do for them; windows decide, and are compared by 128 bits: two polynomials
over the two halves of their words' 128-bit hashes.

Work per hash stays small whatever the skew: a task gathers the anchors or windows of SLICE_HASHES places at a time,
sends each hash once and settles repeats within on the spot, and it remembers the hashes that it has met in several
documents (up to HOT of them), of which it sends no more than the smallest document so far. So a passage that a third of
the documents share costs about a row per task, and the rows that meet under one hash are at most so many. Documents
learn which of their hashes repeat, and find the places by hashing again. Exact copies of a text are told apart first:
only the one with the smallest doc_id is searched, the others are all repeats.

Null texts have no words. Rows with a null doc_id keep their words and are not compared. Rows that share a doc_id are
one document for the purpose of "another document", and each gets a row of its own. Empty tables give no rows. Extra
columns are ignored. A very long text needs memory for its words and some 50 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import prepare_arrow, slices
from cuetide.llm.decontam import rolling

#: Perfect difference sets: every residue but zero is the difference of exactly one pair.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
#: Hashes that are compared within a task before they are sent, and repeated ones that a task remembers.
SLICE_HASHES = 1 << 20
HOT = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each word's 128-bit hash."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    halves = np.frombuffer(b"".join([digest(w) for w in words]), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def window_hashes(words: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """A pair of 64-bit hashes (a structured array) of each window."""
    first, second = (rolling(half, length) for half in words)
    found = np.empty(len(first), PAIR)
    found["a"], found["b"] = first, second
    return found


PAIR = np.dtype([("a", np.uint64), ("b", np.uint64)])


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of at least a third of the length."""
    found = [v for v in COVERS if length - v + 1 >= max(1, length // 3)]
    if not found:
        raise ValueError("passages of fewer than 8 words are too short for the covers")
    return max(found), COVERS[max(found)]


class _Settler:
    """Of the hashes of a task's documents those that must go out: (hash, doc, settled). A hash goes out to be compared
    with its smallest document of the slice. settle_all: rows of a hash that several documents have also go out settled
    (the hash repeats); else those of all but the smallest document do (they are repeats). What a task remembers as hot
    has gone out before: of it a smaller document alone is sent again."""

    def __init__(self, kind: np.dtype, settle_all: bool):
        self.settle_all, self.kind = settle_all, kind
        self.hot, self.least = np.empty(0, kind), np.empty(0, np.int64)

    def _lead(self, h: np.ndarray) -> np.ndarray:
        return h[self.kind.names[0]] if self.kind.names else h

    def rows(self, hashes: list[np.ndarray], docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate(hashes) if hashes else np.empty(0, self.kind)
        if not len(h):
            return h, np.empty(0, np.int64), np.empty(0, bool)
        d = np.repeat(np.array(docs, np.int64), [len(x) for x in hashes])
        # Equal hashes side by side, and each of a document once.
        names = [h[n] for n in reversed(self.kind.names)] if self.kind.names else [h]
        order = np.lexsort((d, *names))
        h, d = h[order], d[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        once = new | np.concatenate(([True], d[1:] != d[:-1]))
        h, d, new = h[once], d[once], new[once]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        least, shared = d[first], size > 1
        # Found by the first half, told by both; what is overlooked is only sent once more.
        place = np.minimum(np.searchsorted(self._lead(self.hot), self._lead(h)[first]), max(0, len(self.hot) - 1))
        met = self.hot[place] == h[first] if len(self.hot) else np.zeros(len(first), bool)
        before = self.least[place] if len(self.hot) else np.zeros(len(first), np.int64)
        is_first = np.zeros(len(h), bool)
        is_first[first] = True
        top = np.repeat(np.where(met, np.minimum(before, least), least), size)
        sent = is_first & np.repeat(~met | (least < before), size)
        known = np.repeat(shared | met, size) if self.settle_all else d > top
        if met.any():
            self.least[place[met]] = np.minimum(self.least[place[met]], least[met])
        fresh = shared & ~met
        if len(self.hot) + int(fresh.sum()) <= HOT and fresh.any():
            hot, low = np.concatenate((self.hot, h[first][fresh])), np.concatenate((self.least, least[fresh]))
            by = np.argsort(self._lead(hot), kind="stable")
            self.hot, self.least = hot[by], low[by]
        return (
            np.concatenate((h[sent], h[known])),
            np.concatenate((d[sent], d[known])),
            np.concatenate((np.zeros(int(sent.sum()), bool), np.ones(int(known.sum()), bool))),
        )


def _search(df: DataFrame, hashes_of, settle_all: bool, wide: bool) -> DataFrame:
    """Rows of _Settler for each slice of a task; hash2 only if wide. df: doc_id, text and perhaps marks (array of long).
    hashes_of: (word hashes, marks) to hashes."""
    prepare_arrow(df.sparkSession)
    fields = ["hash", *(["hash2"] if wide else []), "doc"]
    schema = T.StructType([*[T.StructField(f, T.LongType()) for f in fields], T.StructField("settled", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settler = _Settler(PAIR if wide else np.dtype(np.uint64), settle_all)
        hashes, docs, held = [], [], 0

        def out() -> pa.RecordBatch:
            h, d, settled = settler.rows(hashes, docs)
            parts = [h["a"].copy(), h["b"].copy()] if wide else [h]
            return pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in parts], pa.array(d), pa.array(settled)], names=schema.names)

        for batch in batches:
            marked = batch.column("marks") if "marks" in batch.schema.names else None
            texts, ids = batch.column("text"), batch.column("doc_id")
            for at in range(batch.num_rows):
                own = hashes_of(word_hashes(words_of(texts[at].as_py())), None if marked is None else marked[at].values.to_numpy())
                hashes.append(own)
                docs.append(ids[at].as_py())
                held += len(own)
                if held >= SLICE_HASHES:
                    yield out()
                    hashes, docs, held = [], [], 0
        yield out()

    return df.mapInArrow(run, schema)


def _anchor_hashes(words: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a document's anchors."""
    if len(words[0]) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    period, cover = cover_for(length)
    residues = np.zeros(period, bool)
    residues[list(cover)] = True
    rolled = rolling(words[0], length - period + 1)
    where = np.flatnonzero(np.resize(residues, len(rolled)))
    return rolled[where], where


def _compared(found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds least and most, the smallest and largest document of a hash. Rows to be compared meet under their hash, at most
    a few for each task; settled ones are spread and meet none."""
    lot = F.when(F.col("settled"), F.xxhash64(*keys, "doc"))
    same = Window.partitionBy(*keys, lot)
    return found.select("doc", *keys, "settled", F.min("doc").over(same).alias("least"), F.max("doc").over(same).alias("most"))


def anchors(df: DataFrame, length: int) -> DataFrame:
    """(doc_id, marks): the hashes of anchors that stand in another document too."""
    found = _compared(_search(df, lambda words, _: _anchor_hashes(words, length)[0], True, False), ["hash"])
    return found.where("settled or least < most").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("hash").alias("marks"))


def repeats(df: DataFrame, length: int) -> DataFrame:
    """df: doc_id, text, marks. (doc_id, repeated): hashes of windows that a smaller document has too, both halves."""
    period, _ = cover_for(length)

    def extended(words: tuple[np.ndarray, np.ndarray], marks: np.ndarray) -> np.ndarray:
        hashes, where = _anchor_hashes(words, length)
        hit = where[np.isin(hashes, marks.view(np.uint64))]
        count = max(0, len(words[0]) - length + 1)
        edges = np.zeros(count + 1, np.int64)
        np.add.at(edges, np.clip(hit - (period - 1), 0, count), 1)
        np.add.at(edges, np.clip(hit + 1, 0, count), -1)
        return window_hashes(words, length)[np.cumsum(edges[:-1]) > 0]

    found = _compared(_search(df, extended, False, True), ["hash", "hash2"])
    return found.where("settled or doc > least").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("hash").alias("repeated"), F.collect_list("hash2").alias("repeated2"))


def _cut(df: DataFrame, length: int) -> DataFrame:
    """df: doc_id, text, is_copy, repeated. Adds kept, n_words and n_removed; drops the others."""
    packed = df.select("doc_id", "text", "is_copy", "repeated", "repeated2")
    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sizes, removed, kept = [], [], []
                repeated, second = piece.column("repeated"), piece.column("repeated2")
                for at, (text, copy) in enumerate(zip(piece.column("text").to_pylist(), piece.column("is_copy").to_pylist(), strict=True)):
                    words = words_of(text)
                    sizes.append(len(words))
                    if copy and len(words) >= length:
                        words = []
                    elif repeated[at].is_valid:
                        edges = np.zeros(len(words) + 1, np.int64)
                        bad = [x[at].values.to_numpy().view(np.uint64) for x in (repeated, second)]
                        found, pairs = window_hashes(word_hashes(words), length), set(zip(*(x.tolist() for x in bad), strict=True))
                        own = np.flatnonzero(np.isin(found["a"], bad[0]))
                        own = own[[pair in pairs for pair in found[own].tolist()]] if len(own) else own
                        np.add.at(edges, own, 1)
                        np.add.at(edges, own + length, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                    removed.append(sizes[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    prepare_arrow(df.sparkSession)
    return packed.mapInArrow(run, schema)


def remove_repeats(df: DataFrame, length: int = 50) -> DataFrame:
    """df: doc_id (long) and text. (doc_id, n_words, n_removed, kept): kept is the rest in UTF-8, words joined by blanks."""
    named = df.select(F.col("doc_id").cast("long"), "text")
    docs = named.where("doc_id is not null")
    # One shuffle of the texts serves all the joins below: the plans under them are equal, so Spark reuses it.
    placed = docs.repartition("doc_id")
    firsts = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(False).alias("is_copy")).distinct()
    marks = anchors(placed.join(firsts.select("doc_id"), "doc_id"), length)  # inner: Spark would push a semi-join below the shuffle
    repeated = repeats(placed.join(marks, "doc_id"), length)
    decided = placed.join(firsts, "doc_id", "left").join(repeated, "doc_id", "left").select("doc_id", "text", F.coalesce("is_copy", F.lit(True)).alias("is_copy"), "repeated", "repeated2")
    unnamed = named.where("doc_id is null").select("doc_id", "text", F.lit(False).alias("is_copy"), *[F.lit(None).cast("array<bigint>").alias(c) for c in ("repeated", "repeated2")])
    return _cut(decided, length).unionByName(_cut(unnamed, length))
