"""The registered queries of the operators of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetide.llm import bpe, codebooks, collocations, decontam, langid, license, linededup, matroska, oracles, pii, simhash, substring, urlfilter, warc
from cuetide.llm.common import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.load_spec(tokenizer_path())
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_token_digests(bpe.encode(docs, spec, drop_text=True, decoded="decoded"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    named = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict(named, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(pages, "page_id", "url", "html", folder, min_bytes=0)
    found = warc.read_archives(manifest, folder)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, length=50).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), urlfilter.RULES)


def license_paths(doc_id: Column, source: Column, lang: Column) -> Column:
    """Paths for a table that has none: every fourth document is the LICENSE file of its source, of its language or of one
    of three parts of that, the others lie a directory below these parts."""
    name, part = F.concat(doc_id.cast("string"), F.lit(".txt")), F.concat(F.lit("part"), (doc_id % 3).cast("string"))
    top, language = F.coalesce(source, F.lit("none")), F.coalesce(lang, F.lit("none"))
    depth = F.when(doc_id % 4 == 0, (doc_id / 4).cast("long") % 3)
    return F.when(depth == 0, F.concat_ws("/", top, F.lit("LICENSE"))).when(depth == 1, F.concat_ws("/", top, language, F.lit("LICENSE"))).when(depth == 2, F.concat_ws("/", top, language, part, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, language, part, F.lit("src"), name))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = license_paths(F.col("doc_id"), F.col("source"), F.col("lang"))
    return license.with_licenses(docs.select("doc_id", path.alias("path"), "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(decontam.find_hits(docs, read_table(spark, sf_dir, "benchmark"), n=10))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return matroska.with_media_digests(matroska.with_media(docs, drop_text=True))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.top_phrases(collocations.score(collocations.count_phrases(docs)))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return codebooks.compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": oracles.WARC, "op6_substring": oracles.SUBSTRING, "op9_decontamination": oracles.DECONTAMINATION, "op11_collocations": oracles.COLLOCATIONS, "op12_line_dedup": oracles.LINES, "op13_vector_codes": oracles.VECTOR_CODES}
