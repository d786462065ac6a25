"""A corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberway.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from emberway.llm._store import kept_rows, keyed, unused, written

REJECTED = 0.3  #: a document of this score or more goes


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels and these documents, calls clean."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, REJECTED)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts, the row that exact dedup keeps."""
    key = unused(docs.columns, "row_key")
    docs = keyed(docs, key)
    return kept_rows(docs, exact_dedup.exact_dedup(docs, key=key).where("kept"), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, one row of the smallest doc_id."""
    key = unused(docs.columns, "row_key")
    docs = keyed(docs, key)
    return kept_rows(docs, jaccard_join.near_duplicates(docs, key=key).where("kept"), key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    names = docs.columns
    key, copies = unused(names, "row_key"), unused(names, "copies")
    docs = keyed(docs, key)
    taken = mixing.mix(docs, key=key).where("copies > 0").select(F.col("row").alias(key), F.col("copies").alias(copies))
    rows = docs.join(taken, key)
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each document's text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]
ORACLE_SQL = None  # a trained classifier and hashed draws are beyond SQL; tests/llm/test_pipeline_run.py holds run() against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i + 1}")
    return docs
