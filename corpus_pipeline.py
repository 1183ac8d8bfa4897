"""A training corpus in five stages: language ID, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage is a function of (spark, docs, sf_dir) whose DataFrame is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, and further ones that docs has, unchanged but for text and
n_chars of personal_data. A folder that a stage has read is deleted once the next one is written.

Null texts: language ID rejects them (no letters), so none goes on; where no label is given at all nothing is rejected,
and null and empty texts count as near copies of each other. Ties: of equal or near texts the smallest doc_id stays; rows
with a null doc_id are not compared and stay. Repeated rows of one doc_id stay or go together. Empty tables stay empty.
Columns are only compared by name, so extra ones may have any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetide.llm import bpe, decontam, jaccard, langid, pii
from cuetide.llm.common import let_go, read_table, stored
from cuetide.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some learned language fits; those that language ID rejects go."""
    return langid.keep_recognised(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 over five-word shingles the one with the smallest doc_id."""
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind; n_chars counts the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and digests of the ids and of the text decoded from them."""
    spec = bpe.load_spec(tokenizer_path())
    named = docs.select("doc_id", "lang", "source", "text")
    done = bpe.encode(named, spec, drop_text=True, decoded="decoded")
    return bpe.with_token_digests(done.withColumn("ids", F.col("token_ids"))).withColumnRenamed("ids", "token_ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Language models, fingerprints and tokens are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        let_go(before)
    return STAGES[-1][1](spark, docs, sf_dir)
