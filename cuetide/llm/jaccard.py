"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash bands find candidates, the whole sets decide.

Words and shingle hashes are those of `simhash`; a text is the set of its shingles' hashes, and two texts are linked if
their sets' Jaccard similarity reaches `similarity`. Texts with equal sets are one class, which counts once.

First each set has a SimHash fingerprint, and the one-wildcard variants of `simhash` give components of fingerprints some
bits apart; each member is compared to the component's first text, and stays with it if the sets are similar. Most sets of
similarity 0.8 lie further apart than that, so what this leaves open is found by MinHash: of each set BANDS keys are
made from ROWS minima each; sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS,
which is 0.99995 at 0.8 and rises above. Pairs that share no key and no component of fingerprints are not found; those
that do are decided exactly.

A band whose members SimHash has all put to one text is settled. Members of the others are first compared to one of them, its hub. Only bands that then hold more than one component are
paired out, only across components, and only where neither the distances to the hub nor the shingles that no other set
has rule a pair out for certain. That join holds the sets and compares them itself: only links come out of it, and a
large group of near copies costs a row for each member and band, not each pair.

Null, empty and blank texts have the empty set and are one class. Fewer words than a shingle: the whole sequence is one
shingle. Rows with a null key are not looked at; the filter keeps them. Rows that share a key are one document for the
filter, which drops or keeps them together. Empty tables give none; other columns stay, whatever their names. A very long
text needs memory for its words and eight bytes a shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import add_columns, let_go, spare, stored
from cuetide.llm.components import connected_components
from cuetide.llm.simhash import fingerprint_of, shingle_hashes, with_components

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _FACTOR = _DRAWN[0], _DRAWN[1] | np.uint64(1)
#: Hashes of one text that are permuted at once.
_BLOCK = 512


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes (uint64)."""
    return np.unique(shingle_hashes(text, size))


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS signed 64-bit keys; none for the empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), _BLOCK):
        np.minimum(least, ((hashes[first : first + _BLOCK] ^ _FLIP) * _FACTOR).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), at) for at, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _with_prints(df: DataFrame, text: str, size: int) -> DataFrame:
    def make():
        import xxhash

        def step(values: list) -> tuple[list, ...]:
            sets = [shingle_set(v, size) for v in values]
            prints = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            return [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [band_keys(s) for s in sets], [len(s) for s in sets], prints

        return step

    added = [("digest", T.BinaryType(), pa.binary()), ("bands", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("n", T.IntegerType(), pa.int32()), ("fingerprint", T.LongType(), pa.int64())]
    return add_columns(df, make, text, added, drop=(text,))


def _with_sets(df: DataFrame, text: str, size: int) -> DataFrame:
    def make():
        return lambda values: ([shingle_set(v, size).view(np.int64) for v in values],)

    return add_columns(df, make, text, [("hashes", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], drop=(text,))


def _alike(a: str, b: str) -> Column:
    """The Jaccard similarity of two arrays of distinct hashes: both sizes over that of the union, less one."""
    return (F.size(a) + F.size(b)) / F.size(F.array_union(a, b)) - 1


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: (a, b). Adds the exact similarity of their sets."""
    both = pairs.join(sets.toDF("a", "hashes_a"), "a").join(sets.toDF("b", "hashes_b"), "b")
    return both.select("a", "b", _alike("hashes_a", "hashes_b").alias("alike"))


def likely_pairs(classes: DataFrame) -> DataFrame:
    """classes: (rep, n, fingerprint), stored. Pairs (a, b): b of a component of near fingerprints, and its first text a."""
    found = with_components(classes.where("n > 0").select("rep", "fingerprint"), "rep")
    return found.where("rep <> component_id").select(F.col("component_id").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id): component_id is the smallest key reachable over links."""
    similarity -= 1e-12  # quotients are rounded
    texts = df.where(F.col(key).isNotNull()).select(key, text)
    prints = stored(_with_prints(texts, text, size), "jaccard-prints")
    classes = stored(prints.groupBy("digest").agg(F.min(key).alias("rep"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint")), "jaccard-classes")
    likely = stored(likely_pairs(classes), "jaccard-likely")
    banded = stored(classes.select(F.explode("bands").alias("band"), "rep", "n"), "jaccard-bands")
    crowded = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select(F.col("band").alias("_band"), "held"), "jaccard-crowded")
    members = stored(banded.join(crowded, F.col("band") == F.col("_band")).drop("_band"), "jaccard-members")
    let_go(banded, crowded)
    # Keys and digests are all that is still needed of these two.
    digests, labels = stored(prints.select(key, "digest"), "jaccard-digests"), stored(classes.select("digest", "rep"), "jaccard-labels")
    let_go(prints, classes)
    wanted = stored(members.groupBy(F.col("rep").alias("_rep")).agg(F.sum("held").alias("met")), "jaccard-wanted")
    needed = wanted.select("_rep").union(likely.select("a")).union(likely.select("b")).distinct()
    sets = stored(_with_sets(texts.join(needed, F.col(key) == F.col("_rep"), "left_semi").withColumnRenamed(key, "_k"), text, size), "jaccard-sets")

    close = stored(_compared(likely, sets).where(F.col("alike") >= similarity).select("a", "b"), "jaccard-close")
    joined = members.join(close.groupBy("b").agg(F.min("a").alias("a")), F.col("rep") == F.col("b"), "left").select("band", F.coalesce("a", "rep").alias("part"))
    unsettled = stored(joined.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select(F.col("band").alias("_band")), "jaccard-unsettled")
    whole, members = members, members.join(unsettled, F.col("band") == F.col("_band"), "left_semi")

    # The text that meets most others is the likeliest origin of a band's copies.
    hubs = members.join(wanted, F.col("rep") == F.col("_rep")).groupBy(F.col("band").alias("_band")).agg(F.max_by("rep", F.struct("met", "rep")).alias("hub"))
    members = stored(members.join(stored(hubs, "jaccard-hubs"), F.col("band") == F.col("_band")).select("band", "rep", "n", "hub"), "jaccard-members")
    let_go(whole, unsettled)
    stars = stored(_compared(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), sets), "jaccard-stars")
    near = stars.where(F.col("alike") >= similarity).select("a", "b").union(close)
    found = connected_components(near, "jaccard-first")
    placed = members.join(stars.toDF("_a", "_b", "alike"), (F.col("hub") == F.col("_a")) & (F.col("rep") == F.col("_b")), "left").join(found, F.col("rep") == F.col("node"), "left")
    placed = stored(placed.select("band", "rep", "n", F.coalesce("alike", F.lit(1.0)).alias("alike"), F.coalesce("component", "rep").alias("part")), "jaccard-placed")
    mixed = stored(placed.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select(F.col("band").alias("_band")), "jaccard-mixed")
    open_bands = stored(placed.join(mixed, F.col("band") == F.col("_band"), "left_semi").where("alike < 1"), "jaccard-open")
    # Shingles of one set only, of those still to be compared, are in no intersection.
    compared = sets.join(open_bands.select("rep").distinct(), F.col("_k") == F.col("rep"), "left_semi")
    alone = compared.select("_k", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("_k").alias("_k"), F.count(F.lit(1)).alias("held")).where("held = 1").groupBy("_k").agg(F.count(F.lit(1)).alias("alone"))
    alone = stored(alone, "jaccard-alone")
    counted = open_bands.join(alone, F.col("rep") == F.col("_k"), "left").select("band", "rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"), "alike", "part")
    # An intersection holds at most the shared shingles and a union at least all n: where their quotient is too low nothing links.
    able = stored(counted.where(F.col("shared") >= similarity * F.col("n") - 1e-6), "jaccard-able")
    ends = able.groupBy(F.col("band").alias("_band")).agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    rest = stored(able.join(stored(ends, "jaccard-ends"), F.col("band") == F.col("_band")).drop("_band"), "jaccard-rest")
    # The sets travel with their bands, so that the join itself decides and only links come out of it. A pair stands once,
    # the one of the smaller component first, so a band's last component is not sent to the left, nor its first to the right.
    columns = ["band", "rep", "n", "shared", "alike", "part"]
    left = rest.where("part < most").join(sets, F.col("rep") == F.col("_k")).select(*columns, "hashes").toDF("band", "a", "n_a", "shared_a", "alike_a", "part_a", "hashes_a")
    right = rest.where("part > least").join(sets, F.col("rep") == F.col("_k")).select(*columns, "hashes").toDF("band_b", "b", "n_b", "shared_b", "alike_b", "part_b", "hashes_b")
    most = F.least("shared_a", "shared_b")
    enough = most >= similarity * (F.col("n_a") + F.col("n_b") - most) - 1e-6
    # 1 - Jaccard is a metric: two sets are at least as far apart as their distances to the hub differ.
    reach = F.abs(F.col("alike_a") - F.col("alike_b")) <= 1 - similarity + 1e-6
    met = (F.col("band") == F.col("band_b")) & (F.col("part_a") < F.col("part_b")) & enough & reach
    further = stored(left.join(right, met & (_alike("hashes_a", "hashes_b") >= similarity)).select("a", "b").distinct(), "jaccard-across")
    linked = connected_components(near.union(further), "jaccard-links")

    label = stored(labels.join(linked, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component_id")), "jaccard-label")
    let_go(labels, likely, members, wanted, sets, close, stars, placed, mixed, open_bands, alone, able, rest, further)
    return digests.join(label, F.col("digest") == F.col("_digest")).select(key, "component_id")


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """df without the rows whose key is not the smallest of its component; rows with a null key are kept."""
    found = near_duplicates(df, text, key, size, similarity)
    other = spare(df.columns, "other")
    others = stored(found.where(F.col(key) > F.col("component_id")).select(F.col(key).alias(other)).distinct(), "jaccard-others")
    return df.join(others, F.col(key) == F.col(other), "left_anti")
