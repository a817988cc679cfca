"""Site rates and site-specific models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.grid import bucket, log_gamma_prior, site_rate_grid
from strandmill.functions.markov import expm_many, stationary_distribution
from strandmill.functions.storage import few, written
from strandmill.operators import counts as C
from strandmill.operators.cherries import encoded
from strandmill.operators.fitting import learn_sites


#: Sites whose matrices one group holds.
SITES_TOGETHER = 64


def rate_candidates(rows: DataFrame, log_p, rates: list[float]) -> DataFrame:
    """(family, site, rate, ll): log-posterior of each candidate rate for each site.

    rows: (family, site, x, y, t), a row for each pair of leaves; both directions count.  log_p(t, x, y) is a column.
    """
    grid = rows.sparkSession.createDataFrame([(r, log_gamma_prior(r)) for r in rates], "rate double, prior double")
    per = rows.groupBy("family", "site", "x", "y", "t").agg(F.count("*").alias("n")).crossJoin(F.broadcast(grid))
    ll = F.sum(F.col("n") * (log_p(F.col("t") * F.col("rate"), F.col("x"), F.col("y")) + log_p(F.col("t") * F.col("rate"), F.col("y"), F.col("x"))))
    return per.groupBy("family", "site", "rate").agg((F.first("prior") + ll).alias("ll"))


def best_rates(candidates: DataFrame, digits: int | None = None) -> DataFrame:
    """(family, site, rate): the candidate with the highest ll, the smaller of equals."""
    ll = F.col("ll") if digits is None else F.round("ll", digits)
    return candidates.groupBy("family", "site").agg(F.max_by("rate", F.struct(ll, (-F.col("rate")).alias("o"))).alias("rate"))


def estimate_site_rates(rows: DataFrame, states: list[str], q: np.ndarray, points: list[float], k: int = 20) -> DataFrame:
    """(family, site, rate): best_rates() for any matrix, with quantized times t * rate and a broadcast table of log-probabilities.

    The table has grid points x states x states rows.
    """
    from strandmill.operators.likelihood import log_probabilities

    rates = site_rate_grid(k)
    spark = rows.sparkSession
    grid = spark.createDataFrame([(r, log_gamma_prior(r)) for r in rates], "rate double, prior double")
    rows = rows.where(F.col("x").isin(states) & F.col("y").isin(states))
    per = rows.groupBy("family", "site", "x", "y", "t").agg(F.count("*").alias("n")).crossJoin(F.broadcast(grid))
    per = per.withColumn("bucket", clamped_bucket(F.col("t") * F.col("rate"), points))
    logs = log_probabilities(spark, states, q, points)
    back = logs.select("bucket", F.col("y").alias("x"), F.col("x").alias("y"), F.col("lp").alias("back"))
    both = logs.join(back, ["bucket", "x", "y"]).withColumn("lp", F.col("lp") + F.col("back")).drop("back")
    ll = per.join(F.broadcast(both), ["bucket", "x", "y"]).groupBy("family", "site", "rate").agg((F.first("prior") + F.sum(F.col("n") * F.col("lp"))).alias("ll"))
    return best_rates(ll)


def clamped_bucket(t: Column, points: list[float]) -> Column:
    """bucket(), with times beyond the grid in its first or last point."""
    return bucket(F.greatest(F.least(t, F.lit(points[-1])), F.lit(points[0])), points)


def regularized(counts: DataFrame, rates: DataFrame, prior: DataFrame, points: list[float], strength: float) -> DataFrame:
    """(family, site, bucket, x, y, n): counts mixed with pseudocounts of the same mass in each site and bucket.

    prior: (prior_bucket, x, y, p), joint probabilities of both ends; a site's bucket takes those at its time times
    the site's rate, at the ends of the grid those of the ends.  rates: (family, site, rate).
    """
    times = counts.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(points)], "bucket int, t double")
    mass = counts.groupBy("family", "site", "bucket").agg(F.sum("n").alias("mass"))
    mass = mass.join(F.broadcast(times), "bucket").join(rates, ["family", "site"])
    mass = mass.withColumn("prior_bucket", clamped_bucket(F.col("t") * F.col("rate"), points))
    pseudo = mass.join(F.broadcast(prior), "prior_bucket").select("family", "site", "bucket", "x", "y", (F.col("mass") * F.col("p") * strength).alias("n"))
    own = counts.select("family", "site", "bucket", "x", "y", (F.col("n") * (1 - strength)).alias("n"))
    return own.unionByName(pseudo).groupBy("family", "site", "bucket", "x", "y").agg(F.sum("n").alias("n"))


def prior_probabilities(spark, states: list[str], q: np.ndarray, points: list[float]) -> DataFrame:
    """(prior_bucket, x, y, p): probability of starting in x and being in y after each time; grid points x states x states rows."""
    p = stationary_distribution(q)[None, :, None] * expm_many(q, np.array(points))
    rows = [(b, states[i], states[j], float(p[b, i, j])) for b in range(len(points)) for i in range(len(states)) for j in range(len(states))]
    return spark.createDataFrame(rows, "prior_bucket int, x string, y string, p double")


def learn_site_models(pairs: DataFrame, msa: DataFrame, rates: DataFrame, states: list[str], q: np.ndarray, points: list[float], strength: float = 0.5, epochs: int = 100, strategy: str = "cherry++") -> DataFrame:
    """(family, site, x, y, q): a rate matrix for each site; a site without counts keeps q times its rate."""
    spark = pairs.sparkSession
    raw = C.site_counts(pairs, msa, points, states, strategy)
    mixed = regularized(raw, rates, prior_probabilities(spark, states, q, points), points, strength)
    found = learn_sites(mixed.join(rates, ["family", "site"]), q, states, points, epochs=epochs, scale="rate")
    base = spark.createDataFrame([(a, b, float(q[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)], "x string, y string, q0 double")
    every = rates.crossJoin(F.broadcast(base))  # each site's matrix is the result
    return every.join(found, ["family", "site", "x", "y"], "left").select("family", "site", "x", "y", F.coalesce("q", F.col("q0") * F.col("rate")).alias("q"))


#: Transitions of a family that one task scores at a block of sites.
SCORED_TOGETHER = 20_000


def site_model_likelihood(transitions: DataFrame, models: DataFrame, states: list[str], gap: str | None = None, together: int = SCORED_TOGETHER) -> DataFrame:
    """(family, tid, site, ll): log-probability of what each site of a transition does under the site's own matrix.

    transitions: (family, tid, x_seq, y_seq, t); models: (family, site, x, y, q).  Sites where either end has no state
    are left out.  gap: a state that is conditioned on, so that ends that are no gap are compared among those and a gap
    costs nothing.  A block of sites' matrices are factored once and copied to as many tasks as the family's transitions
    ask for, `together` each, so neither a family nor a transition has to fit a task; sequences move as strings.
    """
    family = transitions.schema["family"].dataType.simpleString()
    at, n = {s: k for k, s in enumerate(states)}, len(states)
    blocked = models.withColumn("block", F.floor(F.col("site") / SITES_TOGETHER).cast("int"))

    def factor(known: pd.DataFrame) -> pd.DataFrame:
        sites, place = np.unique(known["site"].to_numpy(), return_inverse=True)
        q = np.zeros((len(sites), n, n))
        q[place, known["x"].map(at).to_numpy(), known["y"].map(at).to_numpy()] = known["q"].to_numpy()
        values, v = np.linalg.eig(q)
        parts = [np.asarray(x, complex).tobytes() for x in (values, v, np.linalg.inv(v))]
        return pd.DataFrame({"family": [known["family"].iloc[0]], "block": [int(known["block"].iloc[0])], "sites": [sites.astype(np.int64).tobytes()], "values": parts[0:1], "v": parts[1:2], "inverse": parts[2:3]})

    factored = written(blocked.groupBy("family", "block").applyInPandas(factor, f"family {family}, block int, sites binary, values binary, v binary, inverse binary"), "factors")
    many = transitions.groupBy("family").count().where(F.col("count") > together).select("family", F.ceil(F.col("count") / together).cast("int").alias("shares"))
    many, shares = few(written(many, "shares")), F.coalesce("shares", F.lit(1))
    dealt = transitions.join(many, "family", "left").withColumn("share", F.pmod(F.xxhash64("tid", "t", "x_seq", "y_seq"), shares).cast("int"))
    last = F.floor((F.greatest(F.least(F.length("x_seq"), F.length("y_seq")), F.lit(1)) - 1) / SITES_TOGETHER).cast("int")
    part = lambda c: F.substring(c, F.col("block") * SITES_TOGETHER + 1, F.lit(SITES_TOGETHER)).alias(c)
    rows = dealt.select("family", "share", "tid", "t", "x_seq", "y_seq", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    rows = rows.select("family", "share", "block", "tid", "t", part("x_seq"), part("y_seq"))
    copied = factored.join(many, "family", "left").select(F.col("family").alias("its"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "block", "sites", "values", "v", "inverse")

    def run(seen: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if seen.empty or known.empty:
            return pd.DataFrame(columns=["family", "tid", "site", "ll"], dtype=object)
        own = known.iloc[0]
        sites = np.frombuffer(own["sites"], np.int64)
        values, v, inverse = (np.frombuffer(own[c], complex).reshape(len(sites), *shape) for c, shape in (("values", (n,)), ("v", (n, n)), ("inverse", (n, n))))
        first = int(seen["block"].iloc[0]) * SITES_TOGETHER
        place = np.full(SITES_TOGETHER, -1)
        place[sites - first] = np.arange(len(sites))
        x, y = (encoded(seen[c].tolist(), states, SITES_TOGETHER).astype(np.int64) for c in ("x_seq", "y_seq"))
        row, offset = np.nonzero((x >= 0) & (y >= 0) & (place >= 0)[None, :])
        k, a, b, t = place[offset], x[row, offset], y[row, offset], seen["t"].to_numpy()[row, None]
        p = np.empty(len(row))
        for c in range(0, len(row), 1 << 16):
            i = slice(c, c + (1 << 16))
            to = lambda end: np.real((v[k[i], a[i]] * np.exp(values[k[i]] * t[i]) * inverse[k[i], :, end]).sum(axis=1))  # noqa: B023, E731
            p[i] = to(b[i])
            if gap is not None:
                p[i] = np.where(b[i] == at[gap], 1.0, p[i] / np.maximum(1 - to(np.full(len(b[i]), at[gap])), 1e-300))
        return pd.DataFrame({"family": seen["family"].to_numpy()[row], "tid": seen["tid"].to_numpy()[row], "site": (first + offset).astype(np.int32), "ll": np.log(np.maximum(p, 1e-300))})

    kind = f"family {family}, tid {transitions.schema['tid'].dataType.simpleString()}, site int, ll double"
    return rows.groupBy("family", "block", "share").cogroup(copied.groupBy("its", "block", "share")).applyInPandas(run, kind)


def by_transition(likelihoods: DataFrame) -> DataFrame:
    """(family, tid, ll, lls): the sum of site_model_likelihood() over sites, and its values in order of sites."""
    values = F.array_sort(F.collect_list(F.struct("site", "ll")))
    return likelihoods.groupBy("family", "tid").agg(F.sum("ll").alias("ll"), F.transform(values, lambda v: v["ll"]).alias("lls"))
