"""Line dedup: lines that many documents share stay in one of them alone.

A document's text is split at line feeds. A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Lines are exploded with their position, keys are hashed, the distinct documents of each hash are counted, and
a key of at least `least_chars` code points found in at least `least_documents` documents loses its lines everywhere but
in the largest document id that holds it. The positions of lost lines come back to their document, which is put together
again from the positions that are left, in order.

Everything is DataFrame functions. Only hashes (half of a SHA-256) and positions are shuffled by key, never texts: (hash,
document) pairs are made distinct before they are counted, so a line that every document holds is counted from partial
sums. The table of frequent hashes is stored; Spark broadcasts it while its size is small, and beyond that joins by
shuffle, where adaptive execution splits a hot hash, since the other side has it once. Texts are shuffled once, to meet
their positions, by document id and a hash of the text.

A null or empty text is one empty line. Repeated rows of a document id count as one document, and each loses the same
lines. Null ids together are one document, smaller than all others. An empty table gives an empty table. A very long text
is one array of its lines in memory. Other columns pass unchanged; columns named as the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetide.llm.common import spare, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that keys are stripped of.
_SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased. Within ASCII that is lower(), which is much faster than a character map."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def half_sha256(c: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a string's UTF-8."""
    return F.substring(F.unhex(F.sha2(c.cast("binary"), 256)), 1, 16)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_lines(documents: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """(doc, body, pos, hash) of lines whose key is long enough; body tells texts of one document id apart."""
    line = F.trim("line", F.lit(_SPACE))
    exploded = documents.select(F.col(key).alias("doc"), half_sha256(F.coalesce(text, F.lit(""))).alias("body"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    return exploded.where(F.char_length("line") >= least_chars).where(F.char_length(line) >= least_chars).select("doc", "body", "pos", half_sha256(lower_ascii(line)).alias("hash"))


def frequent_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_documents: int = 5) -> DataFrame:
    """(hash, n, top): hashes of keys in enough documents, the number of these and the largest id among them."""
    pairs = _long_lines(documents, key, text, least_chars).select("hash", "doc").distinct()
    return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("top")).where(F.col("n") >= least_documents)


def drop_repeated_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_documents: int = 5, names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """documents with the text that is left, the number of lines it had, and the number it has lost."""
    kept, n_lines, n_dropped = names
    frequent = stored(frequent_lines(documents, key, text, least_chars, least_documents), "frequent-lines")
    long = _long_lines(documents, key, text, least_chars)
    lost = long.join(frequent.select("hash", "top"), "hash").where(~F.col("doc").eqNullSafe(F.col("top")))
    lost = lost.groupBy("doc", "body").agg(F.collect_set("pos").alias("lost"))

    others = [c for c in documents.columns if c not in names]
    own = {name: spare([*documents.columns, *names], name) for name in ("doc", "body", "lost")}
    told = lost.select(*[F.col(a).alias(b) for a, b in own.items()])
    here = spare([*documents.columns, *names, *own.values()], "here")
    body = half_sha256(F.coalesce(text, F.lit("")))
    found = documents.withColumn(here, body).join(told, F.col(key).eqNullSafe(F.col(own["doc"])) & (F.col(here) == F.col(own["body"])), "left")
    lines, gone = _lines(F.col(text)), F.col(own["lost"])
    # Positions ascend, and array_except keeps their order.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    joined = F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")
    return found.select(
        *others,
        F.when(gone.isNull(), F.coalesce(text, F.lit(""))).otherwise(joined).alias(kept),
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped),
    )
