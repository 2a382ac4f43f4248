"""Corpus pipeline: each stage calls one operator of ``sparkmend.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmend.llm import exact_dedup, length_buckets, simhash_trie, toxic_lexicon, winnow
from sparkmend.llm.common import prepare, shared_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_SHINGLE, NEAR_BITS = 3, 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic."""
    prepare(spark)
    return toxic_lexicon.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (largest doc_id)."""
    prepare(spark)
    return exact_dedup.exact_dedup(docs).filter("kept").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (smallest doc_id; of documents
    without one, one besides)."""
    prepare(spark)
    return simhash_trie.keep_one(docs, shingle=NEAR_SHINGLE, max_bits=NEAR_BITS).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    prepare(spark)
    return winnow.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    prepare(spark)
    return length_buckets.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", packing),
]
ORACLE_SQL = None  # the lexicon is learned, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
