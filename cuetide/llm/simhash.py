"""SimHash near-duplicates by deletion-variant signatures.

Texts are lower-cased in A-Z and cut at ASCII white space; word shingles, repeats included, are hashed with XXH64 (seed
42), and a fingerprint bit is set where over half the hashes have it. To link fingerprints that differ in at most three
bits, they are cut into two halves of 32 bits: one of the halves then differs in at most one bit, so with that bit
blanked the two halves are equal. Each fingerprint is indexed under all 64 such one-wildcard variants, an equality join
finds the candidates, and the join's own condition verifies the whole distance and keeps a pair under one key only.

Equal fingerprints are one class, which joins once; groups of copies of any size cost one row. The join's sides are
plain shuffles of a stored table, so Spark splits a key that many different fingerprints share. All joins here and in
`components` ask for sorted shuffles: Spark takes the size of a side before its 64 keys a row, or of a compressed file,
and would else send millions of rows through the driver as a broadcast.

Null, empty and blank texts have the fingerprint zero and link like any other. Fewer words than a shingle: the whole
sequence is one shingle. Rows with equal texts are of one component; a document linked with none is its own component.
Empty tables give none. Columns beyond doc_id and text are ignored by the query and kept by the filter, whatever their
names. Rows that share a doc_id are judged each by the query; the filter drops or keeps them together. A very long text
needs memory for its words and eight bytes a shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import add_columns, spare, stored
from cuetide.llm.components import connected_components

SEED = 42
_WEIGHTS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
#: Hashes of one text that are held at once.
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of each shingle, repeats included (uint64)."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    hashes = hashes.astype("<u8")
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[first : first + _BLOCK].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(_WEIGHTS[counts * 2 > len(hashes)].sum())


def fingerprint(text: str | None, size: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, size))


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", size: int = 3, drop_text: bool = False) -> DataFrame:
    """Add the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda values: ([v - (1 << 64) if v >= 1 << 63 else v for v in (fingerprint(t, size) for t in values)],)

    return add_columns(df, make, text, [(out, T.LongType(), pa.int64())], drop=(text,) if drop_text else ())


def _variants(fp: Column) -> Column:
    """The 64 index keys (number of half and blanked bit, half with that bit zero), packed into a long: 6 and 32 bits."""

    def key(n: Column) -> Column:
        low = n < 32
        half = F.when(low, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
        blank = F.call_function("shiftleft", F.lit(1).cast("long"), n % 32)
        return F.shiftleft(n.cast("long"), 32).bitwiseOR(half.bitwiseAND(F.bitwise_not(blank)))

    return F.transform(F.sequence(F.lit(0), F.lit(63)), key)


def links(classes: DataFrame, most_bits: int = 3) -> DataFrame:
    """classes: (fingerprint, rep), one row per fingerprint. Pairs (a, b) of reps whose fingerprints differ in at most
    most_bits (3 or fewer) bits, each once or, if both halves are close, twice."""
    if not 0 <= most_bits <= 3:
        raise ValueError("two halves with one blanked bit find up to three differing bits")
    indexed = classes.select(F.explode(_variants(F.col("fingerprint"))).alias("key"), "fingerprint", "rep")
    left = indexed.toDF("key", "fp_a", "a")
    right = indexed.toDF("key", "fp_b", "b")
    apart = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    number = F.shiftrightunsigned(left["key"], 32)
    in_half = F.when(number < 32, apart.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(apart, 32))
    # Equal halves meet under all 32 keys of the half, halves one bit apart under that bit's: the former count at bit 0.
    own_key = (in_half != 0) | (number % 32 == 0)
    return left.hint("merge").join(right.hint("merge"), (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= most_bits) & own_key).select("a", "b")


def with_components(prints: DataFrame, key: str, most_bits: int = 3) -> DataFrame:
    """prints: (key, fingerprint as long), stored. Adds component_id, the smallest key reachable over links."""
    classes = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("rep")), "simhash-classes")
    found = connected_components(links(classes, most_bits), "simhash-links")
    label = classes.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select(F.col("fingerprint").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(label.hint("merge"), F.col("fingerprint") == F.col("_fp")).select(key, "fingerprint", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, most_bits: int = 3) -> DataFrame:
    """(key, fingerprint as long, component_id): component_id is the smallest key reachable over links."""
    prints = stored(with_fingerprints(df.select(key, text), text, size=size, drop_text=True), "simhash-prints")
    return with_components(prints, key, most_bits)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, most_bits: int = 3) -> DataFrame:
    """df without the rows whose key is not the smallest of its component; rows with a null key are kept."""
    found = near_duplicates(df.where(F.col(key).isNotNull()), text, key, size, most_bits)
    other = spare(df.columns, "other")
    others = stored(found.where(F.col(key) > F.col("component_id")).select(F.col(key).alias(other)).distinct(), "simhash-others")
    return df.join(others.hint("merge"), F.col(key) == F.col(other), "left_anti")
