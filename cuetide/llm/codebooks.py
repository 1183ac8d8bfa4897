"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Components are made whole numbers, floor(1024 * x), and everything after is exact arithmetic on those. Vectors are cut into
equal consecutive parts; a part position's codebook starts as that part of the vectors with the smallest ids. A round
assigns every part to its nearest entry (squared Euclidean distance, the lower index of equals) and replaces an entry by
the floor of the mean of its parts; unused entries stay. The assignment after the last round gives the codes.

The nearest entry is found by annular norm pruning. By the triangle inequality an entry within distance d of a part has a
norm within d of the part's norm. Entries are sorted by norm, and so are the parts of a batch, in blocks. A block first
meets the entries about its own norms, which gives each part a best distance so far; binary search then gives the
interval of norms that distance still allows, bounds included, and only that annulus is evaluated, exactly. So the result
is the one of an exhaustive search.

A round is one pass of the tasks over their vectors, with the codebooks broadcast (parts x entries x components, whatever
the input). A task gives one row per used entry, with count and sums; these are summed by Spark, and only the codebooks
come to the driver. The whole-number vectors are stored once, as are the codes.

Rows whose vector is null or empty, has a null or non-finite component, or is not as long as that of the smallest id are
left out. Ids may repeat or be null: each row is coded, null ids come last among the smallest, and equal ids are ordered by
their vectors. Null labels are one label. An empty table gives an empty table. Fewer vectors than entries give fewer
entries. Components must be so small that squared distances fit 64 bits (2 ** 28 after scaling for 64 components), else the
task raises. Other columns pass unchanged; columns named as the outputs are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import prepare_arrow, spare, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts that are searched together, and entries about their norms that give the first best distances.
BLOCK, NEAR = 512, 24
OUTPUTS = ("code", "error", "label_error", "codebooks_sha256")


def _numeric(largest: int, width: int) -> type:
    """A type in which squared distances of so many components of that size are exact: doubles while they stay under
    2 ** 53 (sums of whole numbers are then exact in any order), else 64-bit integers."""
    reach = width * (2 * largest) ** 2
    if reach < 1 << 53:
        return np.float64
    if reach < 1 << 63:
        return np.int64
    raise ValueError("vector components are too large for exact 64-bit distances")


class Codebook:
    """The entries of one part position, ready to search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        squares = np.array([sum(int(x) ** 2 for x in row) for row in entries], dtype=object)
        order = np.array(sorted(range(len(entries)), key=lambda i: (squares[i], i)), dtype=np.int64)
        self.index, self.sorted = order, entries[order]
        self.norms = np.sqrt(squares[order].astype(np.float64))
        self.largest = int(np.abs(entries).max(initial=0))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part (rows of int64) the nearest entry's index, and the squared distance."""
        kind = _numeric(max(self.largest, int(np.abs(parts).max(initial=0))), parts.shape[1])
        values, entries = parts.astype(kind), self.sorted.astype(kind)
        squares, entry_squares = (values * values).sum(1), (entries * entries).sum(1)
        norms = np.sqrt(squares.astype(np.float64))
        by_norm = np.argsort(norms, kind="stable")
        codes, distances = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for first in range(0, len(parts), BLOCK):
            rows = by_norm[first : first + BLOCK]
            x, xx, r = values[rows], squares[rows], norms[rows]

            def measured(lo: int, hi: int) -> np.ndarray:
                return xx[:, None] - 2 * (x @ entries[lo:hi].T) + entry_squares[None, lo:hi]

            middle = int(np.searchsorted(self.norms, r[len(r) // 2]))
            lo = max(0, min(middle - NEAR // 2, len(entries) - NEAR))
            best = np.sqrt(measured(lo, min(len(entries), lo + NEAR)).min(1).astype(np.float64))
            # Wider by more than the square roots can be wrong.
            slack = 1e-9 * (r + best + 1)
            lo = int(np.searchsorted(self.norms, (r - best - slack).min(), "left"))
            hi = int(np.searchsorted(self.norms, (r + best + slack).max(), "right"))
            apart = measured(lo, hi)
            least = apart.min(1)
            codes[rows] = np.where(apart == least[:, None], self.index[None, lo:hi], len(entries)).min(1)
            distances[rows] = least
        return codes, distances


def nearest_of_all(books: list[Codebook], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column per part."""
    width = vectors.shape[1] // len(books)
    found = [book.nearest(vectors[:, k * width : (k + 1) * width]) for k, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def whole_numbers(df: DataFrame, vector: str, scale: int, name: str) -> DataFrame:
    """df with vector replaced by whole numbers under a name, without rows whose vector is null, empty or not finite."""
    x = F.col(vector).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(x, bad))
    return usable.withColumn(name, F.transform(x, lambda c: F.floor(c * scale).cast("long"))).drop(*([] if name == vector else [vector]))


def fit(kept: DataFrame, key: str, numbers: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (int64, entries x components) of a table of whole-number vectors, all of one length."""
    spark = kept.sparkSession
    prepare_arrow(spark)
    # At most `entries` vectors.
    start = [r[0] for r in kept.select(key, numbers).orderBy(F.col(key).asc_nulls_last(), numbers).limit(entries).select(numbers).collect()]
    if not start:
        return []
    width = len(start[0]) // parts
    if width * parts != len(start[0]):
        raise ValueError(f"vectors of {len(start[0])} components cannot be cut into {parts} equal parts")
    books = [np.array([row[k * width : (k + 1) * width] for row in start], np.int64).reshape(-1, width) for k in range(parts)]
    sums = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "entry", "n", *sums)])
    arrow = pa.schema([(n, pa.int64()) for n in ("part", "entry", "n", *sums)])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = [Codebook(b) for b in sent.value]
            counts = np.zeros((parts, len(own[0].entries)), np.int64)
            totals = np.zeros((*counts.shape, width), np.int64)
            for batch in batches:
                vectors = _matrix(batch.column(0), parts * width)
                codes, _ = nearest_of_all(own, vectors)
                for k in range(parts):
                    counts[k] += np.bincount(codes[:, k], minlength=counts.shape[1])
                    np.add.at(totals[k], codes[:, k], vectors[:, k * width : (k + 1) * width])
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, entry, counts[part, entry], *totals[part, entry].T)], schema=arrow)

        found = kept.select(numbers).mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
        books = [b.copy() for b in books]
        for row in found.collect():  # at most parts x entries rows
            books[row["part"]][row["entry"]] = [row[c] // row["n"] for c in sums]
        sent.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray], numbers: str, code: str = "code", error: str = "error") -> DataFrame:
    """kept without its vectors, with code (two hexadecimal digits a part) and error (squared distances, summed)."""
    spark = kept.sparkSession
    prepare_arrow(spark)
    names = [f.name for f in kept.schema.fields if f.name != numbers]
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != numbers], T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in sent.value]
        for batch in batches:
            codes, apart = nearest_of_all(own, _matrix(batch.column(numbers), sum(b.entries.shape[1] for b in own)))
            digits = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(digits, pa.string()), pa.array(apart.sum(1), pa.int64())], names=[*names, code, error])

    return kept.mapInArrow(run, schema)


def decode(codes: list[str], books: list[np.ndarray]) -> np.ndarray:
    """The whole-number vectors that codes stand for."""
    index = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, len(books))
    return np.concatenate([book[index[:, k]] for k, book in enumerate(books)], 1)


def _one_length(spark: SparkSession, kept: DataFrame, key: str, numbers: str) -> DataFrame:
    first = kept.select(key, numbers).orderBy(F.col(key).asc_nulls_last(), numbers).select(F.size(numbers)).first()
    return kept if first is None else kept.where(F.size(numbers) == first[0])


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """df without its vectors, with code, error, label_error (the error of all rows of a label) and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part, so a codebook has 1 to 256 entries")
    spark = df.sparkSession
    code, error, label_error, sha256 = OUTPUTS
    slim = df.drop(*OUTPUTS)
    numbers = spare([*slim.columns, *OUTPUTS], "numbers")
    kept = _one_length(spark, stored(whole_numbers(slim, vector, scale, numbers), "vectors"), key, numbers)
    books = fit(kept, key, numbers, parts, entries, rounds)
    if not books:
        return kept.drop(numbers).select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(OUTPUTS, ("string", "long", "long", "string"), strict=True)])
    coded = stored(encode(kept, books, numbers), "vector-codes")
    # A row per label: Spark's own size check decides whether it is broadcast.
    own = spare(coded.columns, "_label")
    by_label = stored(coded.groupBy(F.col(label).alias(own)).agg(F.sum(error).alias(label_error)), "label-errors")
    return coded.join(by_label, F.col(label).eqNullSafe(F.col(own))).drop(own).withColumn(sha256, F.lit(digest(books)))
