"""A corpus pipeline: documents that pass the quality classifier, without exact and near copies, with secrets redacted, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the docs of the next. All but the last return the columns of
documents. Stages work on whatever rows their predecessor kept; null and empty texts, null or
repeated doc_ids, empty tables and further columns are handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotide.llm import exact_dedup, ngram_join, packing, quality, secrets
from echotide.llm.common import discard, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts; it learns from the labels of rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train_on(docs, labels))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in the text replaced and n_chars counted anew."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, with their ids."""
    return packing.pack(packing.encode(docs, public_tokenizers.path("word_bpe_49k.json")), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("n-gram Jaccard join", keep_unlike),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: A classifier, a verified similarity join and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the scratch folder and read again; a stage's table goes once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
