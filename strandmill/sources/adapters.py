"""Domain inputs derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.operators.contacts import distance_contacts

NUCLEOTIDES = ["A", "C", "G", "T"]
#: States that dense matrices are made for.
MOST_STATES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, x, y, t): consecutive events of a user and the days between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    out = ev.select(F.col("user_id").alias("family"), F.col("event_type").alias("x"), F.lead("event_type").over(order).alias("y"), ((F.lead(micros).over(order) - micros) / F.lit(8.64e10)).alias("t"))
    return out.where(F.col("y").isNotNull())


def event_states(spark: SparkSession, sf_dir: str) -> list[str]:
    """The event types, a handful, in order; an error if they are more than a dense matrix allows."""
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("x")).where("x is not null").distinct().orderBy("x").limit(MOST_STATES + 1).collect()
    if len(found) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} event types: too many states for a dense matrix")
    return [r.x for r in found]


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x1, x2, y1, y2, t): return flag and line status of consecutive lines of an order, and decades between shipments."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    order = Window.partitionBy("l_orderkey").orderBy(*keys)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", *keys)
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    out = li.select(
        F.col("l_returnflag").alias("x1"),
        F.col("l_linestatus").alias("x2"),
        F.lead("l_returnflag").over(order).alias("y1"),
        F.lead("l_linestatus").over(order).alias("y2"),
        (F.abs(F.lead(micros).over(order) - micros) / F.lit(3.1536e14)).alias("t"),
    )
    return out.where(F.col("y1").isNotNull())


def embedding_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, seq_name, seq): embeddings of a label as aligned sequences over A, C, G and T."""
    v = lambda x: x.cast("double")
    state = lambda x: F.when(v(x) < -0.085, "A").when(v(x) < 0.0, "C").when(v(x) < 0.085, "G").otherwise("T")
    emb = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    return emb.select(F.col("label").cast("string").alias("family"), F.col("vec_id").alias("seq_name"), F.array_join(F.transform("embedding", state), "").alias("seq"))


def document_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, seq_name, seq): whole documents of a language and source, all but a-z missing.

    Sequences are as long as their texts; a family is as wide as its longest, and what a shorter one lacks is missing.
    """
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    seq = F.regexp_replace("text", "[^a-z]", "-")
    return docs.select(F.concat_ws("_", "lang", "source").alias("family"), F.col("doc_id").alias("seq_name"), seq.alias("seq"))


def heap_edges(msa: DataFrame) -> DataFrame:
    """(family, parent, child, child_ord, length): sequences of a family, by name, as a complete binary tree."""
    number = F.row_number().over(Window.partitionBy("family").orderBy("seq_name")) - 1
    nodes = msa.select("family", F.col("seq_name").alias("node"), number.alias("rn"))
    child = nodes.where("rn > 0").select("family", F.col("node").alias("child"), F.floor((F.col("rn") - 1) / 2).cast("int").alias("rn"), ((F.col("rn") - 1) % 2).alias("child_ord"))
    parent = nodes.select("family", F.col("node").alias("parent"), "rn")
    length = F.lit(0.05) + (F.col("child") % 17) / F.lit(20.0)
    return child.join(parent, ["family", "rn"]).select("family", "parent", "child", "child_ord", length.alias("length"))


#: Distance of vectors that are in contact.
CONTACT = 0.1


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, site, x, y, z): vectors of a label, as residues by id, at their first three components."""
    emb = table(spark, sf_dir, "embeddings").where("label is not null and size(embedding) > 2")
    axis = {c: F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")}
    return emb.select(F.col("label").cast("string").alias("family"), F.col("vec_id").alias("site"), *axis.values())


def embedding_contacts(spark: SparkSession, sf_dir: str, cutoff: float = CONTACT) -> DataFrame:
    """(family, i, j): vectors of a label, as residues by id, whose first three components are closer than cutoff."""
    return distance_contacts(embedding_points(spark, sf_dir), cutoff)


def pattern_contacts(spark: SparkSession, sites: int = 64) -> DataFrame:
    """(i, j): pairs of sites i < j for which 7 i + 13 j is divisible by 11."""
    i = spark.range(sites).select(F.col("id").cast("int").alias("i"))
    j = F.explode(F.sequence(F.col("i") + 1, F.lit(sites))).alias("j")
    return i.select("i", j).where(f"j < {sites} and (i * 7 + j * 13) % 11 = 0")


def site_rate(family: Column, site: Column) -> Column:
    """A made-up site rate from 0.25 to 2."""
    return F.lit(0.25) + ((site * 7 + family.cast("int") * 3) % 8) / F.lit(4.0)
