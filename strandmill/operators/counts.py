"""Quantized counts of state transitions, in long sparse form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.grid import bucket


def with_bucket(transitions: DataFrame, points: list[float], t: Column | None = None) -> DataFrame:
    """Adds bucket and drops rows outside the grid."""
    return transitions.withColumn("bucket", bucket(F.col("t") if t is None else t, points)).where("bucket is not null")


def count_states(transitions: DataFrame, points: list[float], states: list[str] | None = None) -> DataFrame:
    """(bucket, x, y, n): rows (x, y, t), of states in the alphabet, by bucket."""
    if states is not None:
        transitions = transitions.where(F.col("x").isin(states) & F.col("y").isin(states))
    return with_bucket(transitions, points).groupBy("bucket", "x", "y").agg(F.count("*").alias("n"))


def sequence_pairs(pairs: DataFrame, msa: DataFrame) -> DataFrame:
    """(family, x, y, t, x_seq, y_seq): both sequences beside each pair of nodes."""
    seq = lambda c: msa.select("family", F.col("seq_name").alias(c), F.col("seq").alias(f"{c}_seq"))
    return pairs.join(seq("x"), ["family", "x"]).join(seq("y"), ["family", "y"])


def site_transitions(pairs: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """(family, site, x, y, t): one row per pair and site, t times the site's rate if rates (family, rates) are given.

    Sites are exploded from the pair's own row, so residues are never joined.
    """
    letters = lambda c: F.split(F.col(c), "")
    if rates is None:
        zipped, time = F.arrays_zip(letters("x_seq").alias("a"), letters("y_seq").alias("b")), F.col("t")
    else:
        pairs = pairs.join(rates, "family")
        zipped = F.arrays_zip(letters("x_seq").alias("a"), letters("y_seq").alias("b"), F.slice("rates", F.lit(1), F.length("x_seq")).alias("r"))
        time = F.col("t") * F.col("s.r")
    out = pairs.select("family", "t", F.posexplode(zipped).alias("site", "s"))
    return out.select("family", "site", F.col("s.a").alias("x"), F.col("s.b").alias("y"), time.alias("t"))


def count_transitions(pairs: DataFrame, msa: DataFrame, points: list[float], states: list[str], strategy: str, rates: DataFrame | None = None) -> DataFrame:
    """(bucket, x, y, n): counts over all families and sites; an edge weighs 1, a cherry one half in each direction."""
    rows = site_transitions(sequence_pairs(pairs, msa), rates).where(F.col("x").isin(states) & F.col("y").isin(states))
    rows = with_bucket(rows, points)
    if strategy == "edge":
        return rows.groupBy("bucket", "x", "y").agg(F.count("*").cast("double").alias("n"))
    # counting one direction first halves what the second sees
    one = rows.groupBy("bucket", "x", "y").agg(F.count("*").alias("n"))
    return symmetrized(one)


def symmetrized(counts: DataFrame) -> DataFrame:
    """(bucket, x, y, n): half of the counts of both directions."""
    back = counts.select("bucket", F.col("y").alias("x"), F.col("x").alias("y"), "n")
    return counts.select("bucket", "x", "y", "n").unionByName(back).groupBy("bucket", "x", "y").agg((F.sum("n") / 2).cast("double").alias("n"))


def site_counts(pairs: DataFrame, msa: DataFrame, points: list[float], states: list[str], strategy: str) -> DataFrame:
    """(family, site, bucket, x, y, n): counts of each site; times are not scaled by site rates."""
    rows = with_bucket(sequence_pairs(pairs, msa), points)
    zipped = F.arrays_zip(F.split("x_seq", "").alias("a"), F.split("y_seq", "").alias("b"))
    rows = rows.select("family", "bucket", F.posexplode(zipped).alias("site", "s")).select("family", "site", "bucket", F.col("s.a").alias("x"), F.col("s.b").alias("y"))
    rows = rows.where(F.col("x").isin(states) & F.col("y").isin(states))
    one = rows.groupBy("family", "site", "bucket", "x", "y").agg(F.count("*").cast("double").alias("n"))
    if strategy == "edge":
        return one
    back = one.select("family", "site", "bucket", F.col("y").alias("x"), F.col("x").alias("y"), "n")
    return one.unionByName(back).groupBy("family", "site", "bucket", "x", "y").agg((F.sum("n") / 2).alias("n"))


def count_co_transitions(pairs: DataFrame, msa: DataFrame, contacts: DataFrame, points: list[float], states: list[str], strategy: str, distance: int) -> DataFrame:
    """(bucket, x, y, n): transitions of pairs of states at contacting sites i < j at least `distance` apart.

    contacts has (i, j), or (family, i, j).  Both orders of the sites count, and both directions unless strategy is
    edge; times are not scaled by site rates.  Time is looked up once for each pair of sequences.
    """
    rows = with_bucket(sequence_pairs(pairs, msa), points)
    near = contacts.where(f"abs(i - j) >= {int(distance)} and i < j")
    rows = rows.join(near, "family") if "family" in near.columns else rows.join(F.broadcast(near))  # one map for all
    letter = lambda seq, site: F.col(seq).substr(F.col(site) + 1, F.lit(1))
    rows = rows.select("bucket", letter("x_seq", "i").alias("xi"), letter("x_seq", "j").alias("xj"), letter("y_seq", "i").alias("yi"), letter("y_seq", "j").alias("yj"))
    rows = rows.where(F.col("xi").isin(states) & F.col("xj").isin(states) & F.col("yi").isin(states) & F.col("yj").isin(states))
    one = rows.groupBy("bucket", "xi", "xj", "yi", "yj").count()
    return _both_orders(one, strategy)


def _both_orders(counted: DataFrame, strategy: str) -> DataFrame:
    move = lambda a, b, c, d: F.struct(F.concat(a, b).alias("x"), F.concat(c, d).alias("y"))
    ways = [move("xi", "xj", "yi", "yj"), move("xj", "xi", "yj", "yi")]
    if strategy != "edge":
        ways += [move("yi", "yj", "xi", "xj"), move("yj", "yi", "xj", "xi")]
    out = counted.select("bucket", "count", F.explode(F.array(*ways)).alias("m")).select("bucket", "m.x", "m.y", "count")
    return out.groupBy("bucket", "x", "y").agg((F.sum("count") / len(ways)).alias("n"))


def count_pair_states(transitions: DataFrame, points: list[float]) -> DataFrame:
    """(bucket, x, y, n) of rows (x1, x2, y1, y2, t): both orders of the two sites, half each."""
    rows = with_bucket(transitions, points).groupBy("bucket", "x1", "x2", "y1", "y2").count()
    return _both_orders(rows.toDF("bucket", "xi", "xj", "yi", "yj", "count"), "edge")
