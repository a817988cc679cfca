"""Small dense linear algebra of continuous-time Markov chains, for the driver and for pandas functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame


def dense(rates: DataFrame, states: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """States and matrix of a long rate matrix (x, y, q), which has states x states rows."""
    rows = rates.select("x", "y", "q").collect()
    states = states or sorted({r.x for r in rows})
    at = {s: k for k, s in enumerate(states)}
    q = np.zeros((len(states), len(states)))
    for r in rows:
        q[at[r.x], at[r.y]] = r.q
    return states, q


def stationary_distribution(q: np.ndarray) -> np.ndarray:
    """The probabilities that q leaves as they are."""
    n = len(q)
    a = np.vstack([q.T, np.ones(n)])
    pi, *_ = np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)
    pi = np.maximum(pi, 0)
    return pi / pi.sum()


def stationary_distributions(q: np.ndarray, doublings: int = 64) -> np.ndarray:
    """stationary_distribution() of many matrices (matrices, states, states) at once: the chains' steps doubled again and again.

    Of a chain with several closed sets of states it is the one reached from all states equally.
    """
    n = q.shape[-1]
    fastest = np.maximum(-np.diagonal(q, axis1=1, axis2=2).min(axis=1), 1e-300)
    p = np.eye(n) + q / (1.25 * fastest)[:, None, None]  # a step that may stay, so that no chain alternates
    for _ in range(doublings):
        p = np.maximum(p @ p, 0)
        p /= p.sum(axis=2, keepdims=True)
    return p.mean(axis=1)


class Reversible:
    """A reversible chain, factored once for all times."""

    def __init__(self, q: np.ndarray, pi: np.ndarray | None = None):
        self.pi = stationary_distribution(q) if pi is None else pi
        root = np.sqrt(self.pi)
        symmetric = root[:, None] * q / root[None, :]
        if not np.allclose(symmetric, symmetric.T, atol=1e-6 * max(1.0, np.abs(q).max())):
            raise ValueError("the rate matrix is not reversible")
        self.values, vectors = np.linalg.eigh((symmetric + symmetric.T) / 2)
        self.left, self.right = vectors / root[:, None], vectors.T * root[None, :]

    def expm(self, times: np.ndarray) -> np.ndarray:
        """Transition probabilities at each time."""
        p = (self.left[None] * np.exp(np.asarray(times)[:, None, None] * self.values)) @ self.right
        return np.clip(p, 0.0, None)


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor series and squaring."""
    norm = np.abs(a).sum(axis=-1).max(initial=0.0)
    halvings = max(0, int(np.ceil(np.log2(max(norm, 1e-300)))) + 4)
    a = a / 2.0**halvings
    out = term = np.broadcast_to(np.eye(a.shape[-1]), a.shape).copy()
    for k in range(1, 15):
        term = term @ a / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def expm_many(q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Transition probabilities at each time, by factoring where the chain is reversible."""
    try:
        return Reversible(q).expm(times)
    except (ValueError, FloatingPointError, np.linalg.LinAlgError):
        return np.stack([expm(q * t) for t in times])


def mutation_rate(q: np.ndarray) -> float:
    return float(-(stationary_distribution(q) * np.diag(q)).sum())


def normalized(q: np.ndarray, rate: float = 1.0) -> np.ndarray:
    return q * (rate / mutation_rate(q))


def chain_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two independent chains side by side."""
    return np.kron(a, np.eye(len(b))) + np.kron(np.eye(len(a)), b)


def given_no_gap(p: np.ndarray) -> np.ndarray:
    """Transition probabilities, the last state being the gap, given that the end is not the gap; the gap's column is 1."""
    out = p / p[..., :-1].sum(axis=-1, keepdims=True)
    out[..., -1] = 1.0
    return out


#: Complex numbers that derivative_sum() holds in an array, and the condition of eigenvectors beyond which it does without.
AT_ONCE, ILL = 1 << 22, 1e10


def derivative_sum(q: np.ndarray, times: np.ndarray, weights: Callable[[np.ndarray, slice], np.ndarray]) -> np.ndarray:
    """Sum over times and entries of weights times the derivative of transition probabilities by each rate, rates being free.

    weights(probabilities of some times, their slice) has their shape.  Entry (i, j) is the sum of the integrals of
    P(s)[x, i] w[x, y] P(t - s)[j, y] over s.  It comes from the eigenvectors, in batches of times; where those are
    nearly dependent, from the exponential of a block matrix for each time.
    """
    n = len(q)
    values, v = np.linalg.eig(q)
    if np.linalg.cond(v) > ILL:
        return sum(_one_derivative(q, t, weights(expm(q * t)[None], slice(k, k + 1))[0]) for k, t in enumerate(times))
    inverse = np.linalg.inv(v)
    difference = values[:, None] - values[None, :]
    near = np.abs(difference) < 1e-10
    inner = np.zeros((n, n), complex)
    step = max(1, AT_ONCE // (n * n))
    for k in range(0, len(times), step):
        t = times[k : k + step]
        e = np.exp(t[:, None] * values)
        w = weights(np.real((v[None] * e[:, None, :]) @ inverse), slice(k, k + step))
        x = np.where(near, t[:, None, None] * e[:, :, None], (e[:, :, None] - e[:, None, :]) / np.where(near, 1, difference))
        inner += (x * (v.T @ w @ inverse.T)).sum(axis=0)
    return np.real(inverse.T @ inner @ v.T)


def _one_derivative(q: np.ndarray, time: float, weights: np.ndarray) -> np.ndarray:
    n = len(q)
    block = np.zeros((2 * n, 2 * n))
    block[:n, :n] = block[n:, n:] = q.T
    block[:n, n:] = weights
    return expm(block * time)[:n, n:]
