"""Rate matrices in long form (x, y, q): closed-form estimation, transformation and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.ranks import with_before


def jtt_ipw(counts: DataFrame, states: list[str], points: list[float], ipw: bool = True, pseudocount: float = 1e-8, mask: DataFrame | None = None, symmetrize: bool = True, max_time: float | None = None, normalize: bool = False) -> DataFrame:
    """(x, y, q): rate matrix of counts (bucket, x, y, n) over states, by conditional transition probabilities and
    mutabilities; with ipw each bucket's transitions are weighted by its inverse time, else the median time counts.

    Every bucket of the grid takes part with its pseudocounts, whether it has counts or not.
    mask: (x, y, m) with 0 for transitions that are not allowed.  Dense tables here are states x states x buckets.
    """
    spark = counts.sparkSession
    times = [(k, float(t)) for k, t in enumerate(points) if max_time is None or t <= max_time]
    grid = spark.createDataFrame(times, "bucket int, t double")
    own = spark.createDataFrame([(s,) for s in states], "x string")
    dense = F.broadcast(grid).crossJoin(F.broadcast(own)).crossJoin(F.broadcast(own.withColumnRenamed("x", "y")))
    counts = counts.where(F.col("x").isin(states) & F.col("y").isin(states))
    if symmetrize:
        back = counts.select("bucket", F.col("y").alias("x"), F.col("x").alias("y"), (F.col("n") / 2).alias("n"))
        counts = counts.select("bucket", "x", "y", (F.col("n") / 2).alias("n")).unionByName(back)
    counts = counts.groupBy("bucket", "x", "y").agg(F.sum("n").alias("n"))
    full = dense.join(counts, ["bucket", "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + pseudocount)
    if mask is not None:
        full = full.join(F.broadcast(mask.select("x", "y", "m")), ["x", "y"]).withColumn("n", F.col("n") * F.col("m"))
    pair = full.groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("t")).alias("w"))
    row = Window.partitionBy("x")
    off = F.sum(F.when(F.col("x") != F.col("y"), F.col("n"))).over(row)
    weighted = F.sum(F.when(F.col("x") != F.col("y"), F.col("w"))).over(row) if ipw else off / _median([t for _, t in times])
    mutability = weighted / F.sum("n").over(row)
    out = pair.select("x", "y", F.when(F.col("x") == F.col("y"), -mutability).otherwise(mutability * F.col("n") / off).alias("q"))
    return normalized(out) if normalize else out


def _median(values: list[float]) -> float:
    values = sorted(values)
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


def stationary(rates: DataFrame) -> DataFrame:
    """(state, prob) of a rate matrix; the matrix has states x states rows and is solved on the driver."""
    from strandmill.functions.markov import dense, stationary_distribution

    states, q = dense(rates)
    pi = stationary_distribution(q)
    return rates.sparkSession.createDataFrame([(s, float(p)) for s, p in zip(states, pi, strict=True)], "state string, prob double")


def mutation_rate(rates: DataFrame, pi: DataFrame) -> DataFrame:
    """(rate): expected changes in unit time."""
    diagonal = rates.where("x = y").join(pi, F.col("x") == F.col("state"))
    return diagonal.agg(F.sum(-F.col("q") * F.col("prob")).alias("rate"))


def normalized(rates: DataFrame, rate: float = 1.0, pi: DataFrame | None = None) -> DataFrame:
    """The matrix scaled to a mutation rate."""
    now = mutation_rate(rates, stationary(rates) if pi is None else pi).first()["rate"]
    return rates.withColumn("q", F.col("q") * (rate / now))


def chain_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, q) over pairs of states: two independent chains side by side, one changing at a time."""
    left = a.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("q").alias("aq"))
    right = b.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("q").alias("bq"))
    zero = F.lit(0.0)
    q = F.when(F.col("bx") == F.col("by"), F.col("aq")).otherwise(zero) + F.when(F.col("ax") == F.col("ay"), F.col("bq")).otherwise(zero)
    both = left.crossJoin(F.broadcast(right))  # all pairs of entries are the result
    return both.select(F.concat("ax", "bx").alias("x"), F.concat("ay", "by").alias("y"), q.alias("q"))


def metrics(a: DataFrame, b: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """One row: l_infty, rmse, mre and mean_relative_error of the off-diagonal entries of two rate matrices."""
    both = a.select("x", "y", F.col("q").alias("qa")).join(b.select("x", "y", F.col("q").alias("qb")), ["x", "y"]).where("x <> y")
    if mask is not None:
        both = both.join(mask.where("m <> 0").select("x", "y"), ["x", "y"])
    log = F.log(F.col("qa") / F.col("qb"))
    error = F.greatest(F.col("qa") / F.col("qb"), F.col("qb") / F.col("qa")) - 1
    return both.agg(F.max(F.abs(log)).alias("l_infty"), F.sqrt(F.avg(log * log)).alias("rmse"), (F.exp(F.max(F.abs(log))) - 1).alias("mre"), F.avg(error).alias("mean_relative_error"))


def relative_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, error): by how much the larger of two off-diagonal entries exceeds the smaller, as a share of that."""
    both = a.select("x", "y", F.col("q").alias("qa")).join(b.select("x", "y", F.col("q").alias("qb")), ["x", "y"]).where("x <> y")
    return both.select("x", "y", (F.greatest(F.col("qa") / F.col("qb"), F.col("qb") / F.col("qa")) - 1).alias("error"))


def block(rates: DataFrame, states: list[str]) -> DataFrame:
    """The entries between some of the states."""
    return rates.where(F.col("x").isin(states) & F.col("y").isin(states))


def transition_probabilities(rates: DataFrame, time: float) -> DataFrame:
    """(x, y, p) after a time; the matrix has states x states entries and is exponentiated on the driver."""
    from strandmill.functions.markov import dense, expm

    states, q = dense(rates)
    p = expm(q * time)
    return rates.sparkSession.createDataFrame([(a, b, float(p[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)], "x string, y string, p double")


TIE_DIGITS = 10


def correlations(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Pearson and Spearman correlation of the off-diagonal entries' logarithms, rounded to TIE_DIGITS digits, so
    that what differs in the last bits only is a tie."""
    log = lambda c: F.round(F.log10("q"), TIE_DIGITS).alias(c)
    both = a.select("x", "y", log("la")).where("x <> y").join(b.select("x", "y", log("lb")), ["x", "y"])
    # matrices have states x states rows, so one window ranks them all; ties get their average rank
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    ranked = both.withColumns({"ra": rank("la"), "rb": rank("lb")})
    return ranked.agg(F.corr("la", "lb").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def bootstrap_sums(rows: DataFrame, column: str, resamples: int) -> DataFrame:
    """(resample, column): sums over resamples of the families in rows (family, column), as many draws as families.

    Draw k of a resample is the family at the place that a hash of both gives.
    """
    placed = with_before(rows.withColumn("one", F.lit(1)), "family", "one").select(F.col("before").alias("place"), column)
    n = placed.count()
    draws = placed.select(F.col("place").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("resample").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.select("resample", (hashed % n).alias("place")).groupBy("resample", "place").agg(F.count("*").alias("times"))
    return drawn.join(placed, "place").groupBy("resample").agg(F.sum(F.col(column) * F.col("times")).cast("double").alias(column))


def jump_probabilities(rates: DataFrame) -> DataFrame:
    """(x, y, p): where a chain goes when it leaves x."""
    out = F.sum(F.when(F.col("x") == F.col("y"), -F.col("q"))).over(Window.partitionBy("x"))
    return rates.withColumn("p", F.col("q") / out).where("x <> y").select("x", "y", "p")


def ranked_entries(rates: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(x, y, q, share, rank): off-diagonal entries of at least threshold, largest first, with their share of all."""
    off = rates.where("x <> y")
    total = off.agg(F.sum("q").alias("total"))
    out = off.crossJoin(F.broadcast(total)).withColumn("share", F.col("q") / F.col("total"))
    return out.where(F.abs("q") >= threshold).select("x", "y", "q", "share", F.row_number().over(Window.orderBy(F.desc("q"), "x", "y")).alias("rank"))


def synthetic_counts(spark: SparkSession, states: list[str], q, points: list[float], samples: float) -> DataFrame:
    """(bucket, x, y, n): whole parts of samples times transition probabilities at each point."""
    import numpy as np

    from strandmill.functions.markov import expm_many

    n = np.floor(samples * expm_many(np.asarray(q), np.asarray(points)))
    rows = [(b, states[i], states[j], float(n[b, i, j])) for b, i, j in np.argwhere(n > 0).tolist()]
    return spark.createDataFrame(rows, "bucket int, x string, y string, n double")


def equal_rates(spark: SparkSession, states: list[str]) -> DataFrame:
    """(x, y, q): all changes equally likely, one change in unit time."""
    n = len(states)
    return spark.createDataFrame([(a, b, -1.0 if a == b else 1 / (n - 1)) for a in states for b in states], "x string, y string, q double")
