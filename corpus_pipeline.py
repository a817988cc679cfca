"""The training-data pipeline: documents that the quality classifier accepts, one of each group of near-duplicates,
none that shares a span with the benchmark, personal data under pseudonyms, encoded.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import decontamination, pii, quality, sentencepiece_codec, simhash
from strandmill.llm._shared import small_batches, written
from strandmill.llm.queries import PIECES, PII_KEY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the perplexity model trained on documents labelled good rejects."""
    small_batches(spark)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality.keep_accepted(docs, trusted)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near-duplicates, five-word shingles at a similarity of 0.8."""
    small_batches(spark)
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a span with a benchmark item."""
    small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in the place of personal data."""
    return pii.pseudonymise(docs, PII_KEY, count_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the text that they decode to.

    Ids are written before they are decoded: in one stage, each task would keep two Python workers busy.
    """
    small_batches(spark)
    model = public_tokenizers.path(PIECES)
    encoded = written(sentencepiece_codec.encode(docs, model), "encoded")
    return sentencepiece_codec.decode(encoded, model).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pseudonyms", pseudonymise),
    ("encoding", encode),
]

#: SQL cannot express the classifier, the pseudonyms or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
