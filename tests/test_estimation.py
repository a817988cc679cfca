"""Expectation and maximisation, spectral gradients, and many matrices at once, against single fits and closed forms."""

import numpy as np
import pytest

from strandmill.functions.grid import grid
from strandmill.functions.markov import Reversible, derivative_sum, expm, stationary_distribution, stationary_distributions
from strandmill.operators import expectation as E
from strandmill.operators import fitting as T
from strandmill.plans import pipelines as P

TIMES = np.array(grid())[20:110:6]


def reversible(n, seed):
    rng = np.random.default_rng(seed)
    s, pi = rng.gamma(2, 1, (n, n)), rng.dirichlet(np.full(n, 5))
    q = (s + s.T) * pi
    np.fill_diagonal(q, 0)
    q -= np.diag(q.sum(axis=1))
    return q / -(pi * np.diag(q)).sum()


def free(n, seed):
    q = np.random.default_rng(seed).gamma(2, 0.2, (n, n))
    np.fill_diagonal(q, 0)
    return q - np.diag(q.sum(axis=1))


def counts_of(q, samples=1e6):
    pi = stationary_distribution(q)
    return np.stack([samples * pi[:, None] * expm(q * t) for t in TIMES])


def flat(n):
    q = np.full((n, n), 1 / (n - 1))
    np.fill_diagonal(q, -1)
    return q


@pytest.mark.parametrize(("make", "mode"), [(reversible, "pande_reversible"), (free, "default")])
def test_em_finds_the_matrix_and_never_falls(make, mode):
    q = make(4, 1)
    got, seen = E.fit_by_expectation(TIMES, counts_of(q), flat(4), reversible=make is reversible, epochs=4000, tolerance=1e-13)
    assert (np.diff(seen) >= 0).all()
    assert np.abs(got - q).max() < 1e-3
    other, loss = T.fit(TIMES, counts_of(q), flat(4), mode=mode, optimizer="lbfgs", epochs=300)
    assert np.abs(got - other).max() < 1e-3 and np.isclose(-seen[-1], loss, atol=1e-7)
    pi = stationary_distribution(got)
    if make is reversible:
        assert np.allclose(pi[:, None] * got, (pi[:, None] * got).T, atol=1e-9)


def test_em_keeps_the_mask():
    mask = np.ones((4, 4))
    mask[0, 3] = mask[3, 0] = 0
    start = flat(4) * mask
    np.fill_diagonal(start, 0)
    start -= np.diag(start.sum(axis=1))
    got, seen = E.fit_by_expectation(TIMES, counts_of(reversible(4, 2)), start, mask, epochs=50)
    assert got[0, 3] == got[3, 0] == 0 and seen[-1] > seen[0]
    with pytest.raises(ValueError, match="mask"):
        E.fit_by_expectation(TIMES, counts_of(reversible(4, 2)), flat(4), mask)


def test_em_without_counts():
    got, seen = E.fit_by_expectation(TIMES, np.zeros((len(TIMES), 4, 4)), flat(4))
    assert (got == flat(4)).all() and not seen


def test_derivatives_with_and_without_eigenvectors():
    rng = np.random.default_rng(3)
    times, w = TIMES[:4], rng.normal(size=(4, 3, 3))
    lump = np.array([[-1.0, 1, 0], [0, -1, 1], [0, 0, 0]])  # its eigenvectors are dependent
    for q in (free(3, 5), lump):
        got = derivative_sum(q, times, lambda p, own: w[own])
        for i, j in np.ndindex(3, 3):
            step = np.zeros((3, 3))
            step[i, j] = 1e-5
            slope = sum((w[k] * (expm((q + step) * t) - expm((q - step) * t))).sum() for k, t in enumerate(times)) / 2e-5
            assert np.isclose(got[i, j], slope, rtol=1e-5, atol=1e-8)


def test_expected_times_and_changes():
    q = reversible(4, 6)
    counts = counts_of(q, 1000)
    time, changes, _ = E.expectations(q, TIMES, counts)
    assert np.isclose(time.sum(), (counts.sum(axis=(1, 2)) * TIMES).sum())
    assert np.allclose(changes / time[:, None], np.where(np.eye(4), 0, q))  # counts are what the matrix makes


def test_spectral_gradients_reach_the_optimum(monkeypatch):
    q, calls = reversible(6, 7), []
    counts = counts_of(q)
    plain = T.loss_and_gradient
    monkeypatch.setattr(T, "loss_and_gradient", lambda *a: calls.append(1) or plain(*a))
    _, want = T.fit(TIMES, counts, flat(6), optimizer="lbfgs", epochs=300)
    calls.clear()
    got, loss = T.fit(TIMES, counts, flat(6), optimizer="spectral", epochs=400)
    assert np.isclose(loss, want, atol=1e-6) and np.abs(got - q).max() < 0.02 and len(calls) < 1000
    assert np.isclose(T.mean_loss(got, TIMES, counts), loss)
    with pytest.raises(ValueError, match="optimizer"):
        T.fit(TIMES, counts, flat(6), optimizer="other")


@pytest.mark.parametrize("mode", list(T.MODES))
def test_many_matrices_as_one_by_one(mode):
    make = reversible if mode.endswith("_reversible") else free
    start = np.stack([make(4, 10 + k) for k in range(3)])
    counts = np.stack([counts_of(make(4, 20 + k), 500) for k in range(3)])
    got, losses = T.fit_many(TIMES, counts, start, epochs=40, mode=mode)
    for k in range(3):
        want, loss = T.fit(TIMES, counts[k], start[k], mode=mode, epochs=40)
        assert np.allclose(got[k], want, atol=1e-7) and np.isclose(losses[k], loss)


def test_stationary_distributions():
    q = np.stack([reversible(5, k) for k in range(4)] + [free(5, k) for k in range(4)])
    got = stationary_distributions(q)
    assert np.allclose(got, [stationary_distribution(x) for x in q], atol=1e-10)
    two = np.array([[[-1.0, 1.0], [1.0, -1.0]], [[-1e-6, 1e-6], [3e-6, -3e-6]]])
    assert np.allclose(stationary_distributions(two), [[0.5, 0.5], [0.75, 0.25]])
    assert np.allclose(stationary_distributions(np.zeros((1, 3, 3))), 1 / 3)


def test_pipeline_by_em(spark):
    rng = np.random.default_rng(8)
    q, seqs = reversible(4, 9), []
    for k in range(60):
        root = rng.choice(4, 200, p=stationary_distribution(q))
        p = Reversible(q).expm(np.array([0.2]))[0]
        for side in "ab":
            seqs.append((f"f{k // 20}", f"s{k}{side}", "".join("ACGT"[rng.choice(4, p=p[c] / p[c].sum())] for c in root)))
    msa = spark.createDataFrame(seqs, "family string, seq_name string, seq string")
    em = {(r.x, r.y): r.q for r in P.learn_rate_matrix_by_em(msa, list("ACGT")).collect()}
    mle = {(r.x, r.y): r.q for r in P.learn_rate_matrix(msa, list("ACGT"), P.Settings(strategy="cherry", optimizer="lbfgs", epochs=200)).collect()}
    assert all(abs(em[k] - mle[k]) < 5e-3 for k in em)
    with pytest.raises(ValueError, match="no transition"):
        P.learn_rate_matrix(msa.limit(0), list("ACGT"))
