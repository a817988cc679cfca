"""Maximum-likelihood rate matrices from quantized counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.markov import ILL, derivative_sum, expm_many, stationary_distribution, stationary_distributions

_FLOOR = 1e-12


def _softplus(v: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, v)


def _softplus_inverse(v: np.ndarray) -> np.ndarray:
    v = np.maximum(v, _FLOOR)
    return v + np.log(-np.expm1(-v))


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


class WeightedMatrix:
    """Q_ij = S_ij * w_ij for S >= 0 and weights of a stationary distribution pi, from free numbers; pi may be fixed.

    root: w_ij = sqrt(pi_j / pi_i), else pi_j.  symmetric: S is, so that the chain is reversible with pi.
    """

    def __init__(self, initial: np.ndarray, mask: np.ndarray | None = None, pi: np.ndarray | None = None, root: bool = True, symmetric: bool = True):
        n = len(initial)
        self.root, self.symmetric = root, symmetric
        self.mask = np.ones((n, n)) if mask is None else mask
        if np.abs(self.mask * initial - initial)[~np.eye(n, dtype=bool)].max(initial=0) > 1e-8:
            raise ValueError("the initial matrix has rates where the mask allows none")
        self.fixed = pi is not None
        pi = stationary_distribution(initial) if pi is None else pi
        if (pi < 1e-8).any():
            raise ValueError("the stationary distribution is degenerate")
        s = initial / self._weights(pi)
        self.where = np.triu_indices(n, 1) if symmetric else np.nonzero(~np.eye(n, dtype=bool))
        self.theta = np.concatenate([_softplus_inverse((((s + s.T) / 2) if symmetric else s)[self.where]), np.log(pi)])

    def _weights(self, pi: np.ndarray) -> np.ndarray:
        return np.sqrt(pi[None, :] / pi[:, None]) if self.root else np.broadcast_to(pi, (len(pi), len(pi)))

    def value(self) -> np.ndarray:
        n, k = len(self.mask), len(self.where[0])
        s = np.zeros((n, n))
        s[self.where] = _softplus(self.theta[:k])
        e = np.exp(self.theta[k:] - self.theta[k:].max())
        self._pi = e / e.sum()
        self._w = self._weights(self._pi)
        self._off = (s + s.T if self.symmetric else s) * self.mask * self._w
        return self._off - np.diag(self._off.sum(axis=1))

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """From the gradient by Q to that by the free numbers, at the value last made."""
        k = len(self.where[0])
        own = g - np.diag(g)[:, None]  # a rate also lowers its row's diagonal
        np.fill_diagonal(own, 0)
        ds = own * self._w * self.mask
        d_theta = (ds + ds.T if self.symmetric else ds)[self.where] * _logistic(self.theta[:k])
        flow = own * self._off
        d_log = 0.5 * (flow.sum(axis=0) - flow.sum(axis=1)) if self.root else flow.sum(axis=0)
        return np.concatenate([d_theta, np.zeros(len(self._pi)) if self.fixed else d_log - self._pi * d_log.sum()])


class FreeMatrix:
    """Any rate matrix with non-negative rates."""

    def __init__(self, initial: np.ndarray, mask: np.ndarray | None = None):
        self.mask = np.ones(initial.shape) if mask is None else mask
        self.theta = _softplus_inverse(initial[~np.eye(len(initial), dtype=bool)])

    def value(self) -> np.ndarray:
        n = len(self.mask)
        q = np.zeros((n, n))
        q[~np.eye(n, dtype=bool)] = _softplus(self.theta)
        q *= self.mask
        return q - np.diag(q.sum(axis=1))

    def gradient(self, g: np.ndarray) -> np.ndarray:
        n = len(self.mask)
        own = (g - np.diag(g)[:, None]) * self.mask
        return own[~np.eye(n, dtype=bool)] * _logistic(self.theta)


#: Parameterisations by name.
MODES: dict[str, Callable] = {
    "pande_reversible": WeightedMatrix,
    "pande": partial(WeightedMatrix, symmetric=False),
    "stationary_reversible": partial(WeightedMatrix, root=False),
    "stationary": partial(WeightedMatrix, root=False, symmetric=False),
    "default": FreeMatrix,
}


def loss_and_gradient(q: np.ndarray, times: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of counts (buckets, states, states), and its gradient by q."""
    total, loss = counts.sum(), [0.0]

    def weights(p: np.ndarray, own: slice) -> np.ndarray:
        p = np.maximum(p, 1e-300)
        loss[0] -= float((counts[own] * np.log(p)).sum())
        return -counts[own] / p / total

    gradient = derivative_sum(q, times, weights)
    return loss[0] / total, gradient


def mean_loss(q: np.ndarray, times: np.ndarray, counts: np.ndarray) -> float:
    """The loss alone."""
    p = np.maximum(expm_many(q, np.asarray(times, float)), 1e-300)
    return float(-(counts * np.log(p)).sum() / counts.sum())


OPTIMIZERS = ("adam", "sgd", "lbfgs", "spectral")


def fit(times: np.ndarray, counts: np.ndarray, initial: np.ndarray, mask: np.ndarray | None = None, pi: np.ndarray | None = None, mode: str = "pande_reversible", epochs: int = 500, rate: float = 0.1, optimizer: str = "adam") -> tuple[np.ndarray, float]:
    """The best matrix met on the way of Adam's steps (or of plain gradient steps, sgd, of lbfgs, or of spectral gradients), and its loss."""
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"no optimizer {optimizer}")
    used = counts.sum(axis=(1, 2)) > 0
    times, counts = np.asarray(times, float)[used], np.asarray(counts, float)[used]
    model = MODES[mode](initial, mask, pi) if pi is not None else MODES[mode](initial, mask)
    if not len(times):
        return model.value(), float("nan")
    if optimizer == "lbfgs":
        return _quasi_newton(model, times, counts, epochs)
    if optimizer == "spectral":
        return _spectral(model, times, counts, epochs)
    mean = square = np.zeros_like(model.theta)
    best, best_loss = model.value(), np.inf
    for step in range(1, epochs + 1):
        q = model.value()
        loss, g = loss_and_gradient(q, times, counts)
        if loss < best_loss:
            best, best_loss = q, loss
        g = model.gradient(g)
        if optimizer == "sgd":
            model.theta = model.theta - rate * g
            continue
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        model.theta = model.theta - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return best, best_loss


def _quasi_newton(model, times: np.ndarray, counts: np.ndarray, steps: int, memory: int = 10) -> tuple[np.ndarray, float]:
    """Steps along the gradient as turned by the last `memory` changes of place and gradient, halved until the loss falls."""

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        model.theta = theta
        q = model.value()
        loss, g = loss_and_gradient(q, times, counts)
        return loss, model.gradient(g), q

    theta = model.theta
    loss, g, q = at(theta)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, y in reversed(moves):
            a = (s @ d) / (s @ y)
            d = d - a * y
            used.append(a)
        if moves:
            d = d * (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1])
        for (s, y), a in zip(moves, reversed(used), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, size = float(g @ d), 1.0
        if slope >= 0 or np.abs(g).max() < 1e-12:
            break
        while size > 1e-12:
            new_loss, new_g, new_q = at(theta + size * d)
            if np.isfinite(new_loss) and new_loss <= loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * d, new_g - g
        if s @ y > 1e-14:
            moves = [*moves[-(memory - 1) :], (s, y)]
        theta, loss, g, q = theta + s, new_loss, new_g, new_q
    return q, loss


def _spectral(model, times: np.ndarray, counts: np.ndarray, steps: int, memory: int = 10) -> tuple[np.ndarray, float]:
    """Steps down the gradient whose length is what the last step says of the curvature, halved until the loss is below the
    worst of the last `memory`: it may rise for a while.  The best matrix met, and its loss."""

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        model.theta = theta
        q = model.value()
        loss, g = loss_and_gradient(q, times, counts)
        return loss, model.gradient(g), q

    theta = model.theta
    loss, g, q = at(theta)
    best, best_loss = q, loss
    recent, length = [loss], 1 / max(np.abs(g).max(), 1e-12)
    for _ in range(steps):
        if np.abs(g).max() < 1e-9:
            break
        size = length
        while size > 1e-14:
            new_loss, new_g, new_q = at(theta - size * g)
            if np.isfinite(new_loss) and new_loss <= max(recent) - 1e-4 * size * (g @ g):
                break
            size /= 2
        else:
            break
        s, y = -size * g, new_g - g
        length = float(np.clip((s @ s) / (s @ y), 1e-10, 1e10)) if s @ y > 0 else 1e3 * size
        theta, loss, g, q = theta + s, new_loss, new_g, new_q
        recent = [*recent[-(memory - 1) :], loss]
        if loss < best_loss:
            best, best_loss = q, loss
    return best, best_loss


def dense_counts(counts: pd.DataFrame, states: list[str], n_buckets: int) -> np.ndarray:
    at = {s: k for k, s in enumerate(states)}
    out = np.zeros((n_buckets, len(states), len(states)))
    for b, x, y, n in counts[["bucket", "x", "y", "n"]].itertuples(index=False):
        out[int(b), at[x], at[y]] += n
    return out


def learn_from_counts(counts: DataFrame, initial: DataFrame, states: list[str], points: list[float], mask: DataFrame | None = None, mode: str = "pande_reversible", epochs: int = 500, rate: float = 0.1, optimizer: str = "adam") -> DataFrame:
    """(x, y, q) of the most likely matrix.  Counts have buckets x states x states rows at most, whatever the data."""
    from strandmill.functions.markov import dense

    q0 = dense(initial, states)[1]
    m = None if mask is None else dense(mask.select("x", "y", F.col("m").cast("double").alias("q")), states)[1]
    own = counts.where(F.col("x").isin(states) & F.col("y").isin(states)).toPandas()
    q, _ = fit(np.array(points), dense_counts(own, states, len(points)), q0, m, mode=mode, epochs=epochs, rate=rate, optimizer=optimizer)
    rows = [(a, b, float(q[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)]
    return counts.sparkSession.createDataFrame(rows, "x string, y string, q double")


class WeightedMatrices:
    """WeightedMatrix of many matrices at once, without masks."""

    def __init__(self, initial: np.ndarray, root: bool = True, symmetric: bool = True):
        n = initial.shape[1]
        self.root, self.symmetric = root, symmetric
        pi = stationary_distributions(initial)
        if (pi < 1e-8).any():
            raise ValueError("the stationary distribution is degenerate")
        s = initial / self._weights(pi)
        self.where = np.triu_indices(n, 1) if symmetric else np.nonzero(~np.eye(n, dtype=bool))
        self.theta = np.concatenate([_softplus_inverse(((s + s.transpose(0, 2, 1)) / 2 if symmetric else s)[:, *self.where]), np.log(pi)], axis=1)

    def _weights(self, pi: np.ndarray) -> np.ndarray:
        return np.sqrt(pi[:, None, :] / pi[:, :, None]) if self.root else np.broadcast_to(pi[:, None, :], (*pi.shape, pi.shape[1]))

    def value(self) -> np.ndarray:
        k, n = len(self.where[0]), self.theta.shape[1] - len(self.where[0])
        s = np.zeros((len(self.theta), n, n))
        s[:, *self.where] = _softplus(self.theta[:, :k])
        e = np.exp(self.theta[:, k:] - self.theta[:, k:].max(axis=1, keepdims=True))
        self.pi = e / e.sum(axis=1, keepdims=True)
        self._w = self._weights(self.pi)
        self._off = (s + s.transpose(0, 2, 1) if self.symmetric else s) * self._w
        return _with_diagonal(self._off)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """From the gradients by Q to those by the free numbers, at the value last made."""
        k = len(self.where[0])
        own = _by_rate(g)
        ds = own * self._w
        d_theta = (ds + ds.transpose(0, 2, 1) if self.symmetric else ds)[:, *self.where] * _logistic(self.theta[:, :k])
        flow = own * self._off
        d_log = 0.5 * (flow.sum(axis=1) - flow.sum(axis=2)) if self.root else flow.sum(axis=1)
        return np.concatenate([d_theta, d_log - self.pi * d_log.sum(axis=1, keepdims=True)], axis=1)


class FreeMatrices:
    """FreeMatrix of many matrices at once, without masks."""

    pi = None

    def __init__(self, initial: np.ndarray):
        self.where = np.nonzero(~np.eye(initial.shape[1], dtype=bool))
        self.n = initial.shape[1]
        self.theta = _softplus_inverse(initial[:, *self.where])

    def value(self) -> np.ndarray:
        q = np.zeros((len(self.theta), self.n, self.n))
        q[:, *self.where] = _softplus(self.theta)
        return _with_diagonal(q)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return _by_rate(g)[:, *self.where] * _logistic(self.theta)


def _with_diagonal(off: np.ndarray) -> np.ndarray:
    q, at = off.copy(), np.arange(off.shape[1])
    q[:, at, at] = -off.sum(axis=2)
    return q


def _by_rate(g: np.ndarray) -> np.ndarray:
    """Gradients by rates, each of which also lowers its row's diagonal."""
    at = np.arange(g.shape[1])
    own = g - g[:, at, at][:, :, None]
    own[:, at, at] = 0
    return own


#: MODES of many matrices at once.
MANY: dict[str, Callable] = {
    "pande_reversible": WeightedMatrices,
    "pande": partial(WeightedMatrices, symmetric=False),
    "stationary_reversible": partial(WeightedMatrices, root=False),
    "stationary": partial(WeightedMatrices, root=False, symmetric=False),
    "default": FreeMatrices,
}


def losses_and_gradients(q: np.ndarray, pi: np.ndarray | None, times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """loss_and_gradient() of many matrices with their counts (sites, buckets, ...); those with pi are reversible.

    Irreversible matrices whose eigenvectors are nearly dependent are worked out one by one.
    """
    if pi is not None:
        root = np.sqrt(pi)
        symmetric = root[:, :, None] * q / root[:, None, :]
        values, u = np.linalg.eigh((symmetric + symmetric.transpose(0, 2, 1)) / 2)
        v, inverse = u / root[:, :, None], u.transpose(0, 2, 1) * root[:, None, :]
        ill = np.zeros(len(q), bool)
    else:
        values, v = np.linalg.eig(q)
        ill = np.linalg.cond(v) > ILL
        v = np.where(ill[:, None, None], np.eye(q.shape[1]), v)
        inverse = np.linalg.inv(v)
    e = np.exp(times[None, :, None] * values[:, None, :])
    p = np.maximum(np.real((v[:, None] * e[:, :, None, :]) @ inverse[:, None]), 1e-300)
    total = np.maximum(counts.sum(axis=(1, 2, 3)), 1e-300)
    loss = -(counts * np.log(p)).sum(axis=(1, 2, 3)) / total
    g = -counts / p / total[:, None, None, None]
    difference = values[:, :, None] - values[:, None, :]
    near = np.abs(difference) < 1e-10
    x = (e[:, :, :, None] - e[:, :, None, :]) / np.where(near, 1, difference)[:, None]
    x = np.where(near[:, None], times[None, :, None, None] * e[:, :, :, None], x)
    inner = (x * (v.transpose(0, 2, 1)[:, None] @ g @ inverse.transpose(0, 2, 1)[:, None])).sum(axis=1)
    gradient = np.real(inverse.transpose(0, 2, 1) @ inner @ v.transpose(0, 2, 1))
    for k in np.flatnonzero(ill):
        loss[k], gradient[k] = loss_and_gradient(q[k], times, counts[k]) if counts[k].any() else (0.0, np.zeros_like(q[k]))
    return loss, gradient


def fit_many(times: np.ndarray, counts: np.ndarray, initial: np.ndarray, epochs: int = 100, rate: float = 0.1, mode: str = "pande_reversible") -> tuple[np.ndarray, np.ndarray]:
    """fit() of many sites at once by Adam's steps: the best matrices met, each by its own loss, and the losses.

    A site without counts keeps its start.
    """
    used = counts.sum(axis=(0, 2, 3)) > 0
    times, counts = np.asarray(times, float)[used], np.asarray(counts, float)[:, used]
    model = MANY[mode](initial)
    best, best_loss = model.value(), np.full(len(initial), np.inf)
    if not len(times):
        return best, np.full(len(initial), np.nan)
    mean, square = np.zeros_like(model.theta), np.zeros_like(model.theta)
    for step in range(1, epochs + 1):
        q = model.value()
        loss, g = losses_and_gradients(q, model.pi if mode.endswith("_reversible") else None, times, counts)
        better = loss < best_loss
        best[better], best_loss[better] = q[better], loss[better]
        g = model.gradient(g)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        model.theta = model.theta - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return best, best_loss


#: Numbers that one batch of sites holds in an array: sites x buckets x states x states.
BATCH_NUMBERS = 2_000_000


def learn_sites(counts: DataFrame, initial: np.ndarray, states: list[str], points: list[float], epochs: int = 100, rate: float = 0.1, scale: str | None = None, mode: str = "pande_reversible") -> DataFrame:
    """(family, site, x, y, q): a matrix for each site of counts (family, site, bucket, x, y, n), started from initial
    times the column scale, if there is one; a site without counts does not occur.

    Neighbouring sites of a family are fitted together, as many as BATCH_NUMBERS allows.
    """
    family, site = (counts.schema[c].dataType.simpleString() for c in ("family", "site"))
    times, n, at = np.array(points), len(states), {s: k for k, s in enumerate(states)}
    together = max(1, BATCH_NUMBERS // (len(points) * n * n))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sites, place = np.unique(group["site"].to_numpy(), return_inverse=True)
        dense = np.zeros((len(sites), len(points), n, n))
        x, y = (group[c].map(at).to_numpy() for c in "xy")
        np.add.at(dense, (place, group["bucket"].to_numpy(), x, y), group["n"].to_numpy())
        by_site = np.ones(len(sites))
        if scale:
            by_site[place] = group[scale].to_numpy()
        q, _ = fit_many(times, dense, initial[None] * by_site[:, None, None], epochs, rate, mode)
        names = np.array(states)
        out = {"family": group["family"].iloc[0], "site": np.repeat(sites, n * n), "x": np.tile(np.repeat(names, n), len(sites)), "y": np.tile(names, n * len(sites)), "q": q.ravel()}
        return pd.DataFrame(out)

    own = counts.where(F.col("x").isin(states) & F.col("y").isin(states)).withColumn("batch", F.floor(F.col("site") / together))
    return own.groupBy("family", "batch").applyInPandas(run, f"family {family}, site {site}, x string, y string, q double")
