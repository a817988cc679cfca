"""Rate matrices by expectation and maximisation: expected times in states and numbers of changes, given quantized counts.

Between two observed ends, a chain's expected time in state i and changes from i to j are integrals over the way, which the
eigenvectors give in closed form.  New rates are changes over time; a reversible matrix has its exchangeabilities and
stationary distribution improved in turn.  Neither step can lower the likelihood, and rates that are zero stay so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.markov import dense, derivative_sum, stationary_distribution
from strandmill.operators.fitting import dense_counts

#: Improvement of the mean log-likelihood under which steps end.
TOLERANCE = 1e-10


def expectations(q: np.ndarray, times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected times in states, changes between them, and the counts' mean log-likelihood."""
    total, log = counts.sum(), [0.0]

    def weights(p: np.ndarray, own: slice) -> np.ndarray:
        p = np.maximum(p, 1e-300)
        log[0] += float((counts[own] * np.log(p)).sum())
        return counts[own] / p

    shared = np.maximum(derivative_sum(q, times, weights), 0)
    changes = q * shared
    np.fill_diagonal(changes, 0)
    return np.diag(shared).copy(), changes, log[0] / total


def improved(q: np.ndarray, time: np.ndarray, changes: np.ndarray, reversible: bool, rounds: int = 50) -> np.ndarray:
    """The matrix that makes expected times and changes most likely."""
    if reversible:
        pi = stationary_distribution(q)
        both = changes + changes.T
        for _ in range(rounds):
            below = time[:, None] * pi[None, :] + time[None, :] * pi[:, None]
            s = np.divide(both, below, out=np.zeros_like(both), where=below > 0)
            spent = s.T @ time
            # a state that nothing enters keeps its weight: no rate depends on it
            new = np.divide(changes.sum(axis=0), spent, out=pi.copy(), where=(spent > 0) & (changes.sum(axis=0) > 0))
            new /= new.sum()
            if np.abs(new - pi).max() < 1e-14:
                break
            pi = new
        below = time[:, None] * pi[None, :] + time[None, :] * pi[:, None]
        out = np.divide(both, below, out=np.zeros_like(both), where=below > 0) * pi[None, :]
    else:
        out = np.divide(changes, time[:, None], out=q.copy(), where=time[:, None] > 0)
    np.fill_diagonal(out, 0)
    return out - np.diag(out.sum(axis=1))


def fit_by_expectation(times: np.ndarray, counts: np.ndarray, initial: np.ndarray, mask: np.ndarray | None = None, reversible: bool = True, epochs: int = 500, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[float]]:
    """The most likely matrix met, and the mean log-likelihood of each, which never falls.

    A start that has rates where the mask allows none is an error.  Without counts the start is the result.
    """
    if mask is not None and np.abs(initial * (1 - mask))[~np.eye(len(initial), dtype=bool)].max(initial=0) > 1e-8:
        raise ValueError("the initial matrix has rates where the mask allows none")
    used = counts.sum(axis=(1, 2)) > 0
    times, counts = np.asarray(times, float)[used], np.asarray(counts, float)[used]
    q, best, seen = initial, initial, []
    for _ in range(epochs if len(times) else 0):
        time, changes, log = expectations(q, times, counts)
        if seen and log < seen[-1]:  # by rounding only
            break
        best, ended = q, bool(seen) and log - seen[-1] < tolerance
        seen.append(log)
        if ended:
            break
        q = improved(q, time, changes, reversible)
    return best, seen


def learn_by_expectation(counts: DataFrame, initial: DataFrame, states: list[str], points: list[float], mask: DataFrame | None = None, reversible: bool = True, epochs: int = 500) -> DataFrame:
    """(x, y, q) from counts (bucket, x, y, n), of which there are buckets x states x states at most, whatever the data."""
    m = None if mask is None else dense(mask.select("x", "y", F.col("m").cast("double").alias("q")), states)[1]
    own = counts.where(F.col("x").isin(states) & F.col("y").isin(states)).toPandas()
    q, _ = fit_by_expectation(np.array(points), dense_counts(own, states, len(points)), dense(initial, states)[1], m, reversible, epochs)
    rows = pd.DataFrame({"x": np.repeat(states, len(states)), "y": np.tile(states, len(states)), "q": q.ravel()})
    return counts.sparkSession.createDataFrame(rows, "x string, y string, q double")
