"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import collocations, decontamination, embedding_links, filter_audit, grammar_shards, pii, quality, sentencepiece_codec, sharding, simhash, substring, token_counts, toxicity
from strandmill.llm._shared import shared_folder, small_batches
from strandmill.llm.oracles import ORACLE_SQL  # noqa: F401

#: A model file of a public tokenizer, read as a unigram vocabulary.
PIECES = "piece_bpe_32k.model"
#: The key of the test tables' pseudonyms; a real one is a secret of the caller's.
PII_KEY = "test tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data: doc_id, text, n_pseudonyms (values replaced).  A null text stays null."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_simhash_pivot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of all documents; texts without words have fingerprint 0."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_count_only_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and score (of the best cut into pieces) of all documents; 0 for null and empty texts."""
    found = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return found.withColumnRenamed("id", "doc_id")


def op4_difference_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all documents: words in windows that also start earlier are removed."""
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return found.withColumnRenamed("id", "doc_id")


def op5_re_pair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, read back from the shards that they were written to."""
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    shards = grammar_shards.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return grammar_shards.read_shards(shards).withColumnRenamed("id", "doc_id")


def op6_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of all vectors; those without a direction link with nothing."""
    found = embedding_links.links(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of all documents against all benchmark items."""
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op8_gated_network_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents; the network learns from labels outside the held-out fold."""
    found = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and accepted of all documents; documents labelled good are the trusted text."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality.classify(_table(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")


def op10_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the text that they decode to, of all documents."""
    model = public_tokenizers.path(PIECES)
    encoded = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model)
    decoded = sentencepiece_codec.decode(encoded, model)
    return decoded.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of all documents, shuffled into 24 shards; rows are the law."""
    found = sharding.shuffled(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_positional_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    return collocations.collocations(_table(spark, sf_dir, "documents")).withColumnRenamed("part", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms,
        op2_simhash_pivot_tables,
        op3_count_only_viterbi,
        op4_difference_cover_anchors,
        op5_re_pair_shards,
        op6_collision_counting,
        op7_winnowing,
        op8_gated_network_toxicity,
        op9_kneser_ney_quality,
        op10_sentencepiece_viterbi,
        op11_feistel_shards,
        op12_filter_interaction,
        op13_positional_collocations,
    )
}
