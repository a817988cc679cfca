import numpy as np
import pytest

from strandmill.functions import markov as L
from strandmill.operators import fitting as E
from strandmill.operators import rates as R

POINTS = [0.123, 0.9, 0.5]
TOY = [[[100, 3, 2], [0, 90, 7], [1, 10, 130]], [[110, 5, 1], [1, 91, 2], [3, 11, 94]], [[87, 1, 0], [6, 76, 4], [2, 1, 88]]]
WANT = {
    (True, False): [[-0.1258345701, 0.0805341249, 0.0453004453], [0.1153358943, -0.3676331631, 0.2522972688], [0.0598603237, 0.2327901477, -0.2926504714]],
    (True, True): [[-0.0738637878, 0.0738637878, 0], [0.1153358943, -0.3676331631, 0.2522972688], [0, 0.2468221951, -0.2468221951]],
    (False, False): [[-0.0807754443, 0.0516962843, 0.0290791599], [0.0566371681, -0.1805309735, 0.1238938053], [0.0269461078, 0.1047904192, -0.1317365269]],
    (False, True): [[-0.0524590164, 0.0524590164, 0], [0.0566371681, -0.1805309735, 0.1238938053], [0, 0.1062215478, -0.1062215478]],
}


def long(spark, matrix, states="ABC", name="q"):
    return spark.createDataFrame([(a, b, float(matrix[i][j])) for i, a in enumerate(states) for j, b in enumerate(states)], f"x string, y string, {name} double")


def toy_counts(spark):
    return spark.createDataFrame([(b, x, y, float(m[i][j])) for b, m in enumerate(TOY) for i, x in enumerate("ABC") for j, y in enumerate("ABC")], "bucket int, x string, y string, n double")


@pytest.mark.parametrize("ipw", [True, False])
@pytest.mark.parametrize("masked", [True, False])
def test_closed_form(spark, ipw, masked):
    mask = long(spark, [[1, 1, 0], [1, 1, 1], [0, 1, 1]], name="m") if masked else None
    _, q = L.dense(R.jtt_ipw(toy_counts(spark), list("ABC"), POINTS, ipw=ipw, mask=mask), list("ABC"))
    np.testing.assert_allclose(q, WANT[ipw, masked], atol=1e-8)


def test_metrics(spark):
    one = R.metrics(long(spark, [[-1, 1], [2, -2]], "AB"), long(spark, [[-2, 2], [3, -3]], "AB")).first()
    assert one.l_infty == pytest.approx(np.log(2)) and one.rmse == pytest.approx(0.5678269844632537)
    two = R.metrics(long(spark, [[-2, 2], [3, -3]], "AB"), long(spark, [[-3, 3], [5, -5]], "AB")).first()
    assert two.mre == pytest.approx(2 / 3)


def random_reversible(n, seed):
    rng = np.random.default_rng(seed)
    s, pi = rng.gamma(1, 1, (n, n)), rng.dirichlet(np.ones(n) * 5)
    q = (s + s.T) * pi
    np.fill_diagonal(q, 0)
    q -= np.diag(q.sum(axis=1))
    return L.normalized(q), pi


def test_exponentials_and_stationary_distribution():
    q, pi = random_reversible(6, 1)
    np.testing.assert_allclose(L.stationary_distribution(q), pi, atol=1e-10)
    for t in (1e-4, 0.3, 7.0):
        np.testing.assert_allclose(L.Reversible(q).expm(np.array([t]))[0], L.expm(q * t), atol=1e-10)
    cyclic = np.array([[-1.0, 1, 0], [0, -1, 1], [1, 0, -1]])
    p = L.expm_many(cyclic, np.array([0.5]))[0]
    np.testing.assert_allclose(p.sum(axis=1), 1)
    assert L.mutation_rate(q) == pytest.approx(1)
    both = L.chain_product(q, q)
    np.testing.assert_allclose(L.expm(both), np.kron(L.expm(q), L.expm(q)), atol=1e-10)
    given = L.given_no_gap(L.expm(q))
    np.testing.assert_allclose(given[:, :-1].sum(axis=1), 1)


def test_chain_product_of_frames(spark):
    q, _ = random_reversible(3, 2)
    states, got = L.dense(R.chain_product(long(spark, q), long(spark, q)))
    np.testing.assert_allclose(got, L.chain_product(q, q))
    assert states[:2] == ["AA", "AB"]


@pytest.mark.parametrize("model", sorted(E.MODES))
def test_gradient_is_the_difference_quotient(model):
    q, _ = random_reversible(4, 3)
    times, rng = np.array([0.1, 0.7]), np.random.default_rng(0)
    counts = rng.integers(1, 50, (2, 4, 4)).astype(float)
    m = E.MODES[model](q)
    _, g = E.loss_and_gradient(m.value(), times, counts)
    g = m.gradient(g)
    for k in range(len(m.theta)):
        at = m.theta.copy()
        values = []
        for step in (1e-5, -1e-5):
            m.theta = at.copy()
            m.theta[k] += step
            values.append(E.loss_and_gradient(m.value(), times, counts)[0])
        m.theta = at
        assert g[k] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)


def test_likelihood_recovers_the_matrix():
    q, pi = random_reversible(4, 4)
    times = np.array([0.05, 0.2, 0.8])
    counts = 1e5 * pi[None, :, None] * L.expm_many(q, times)
    start, _ = random_reversible(4, 9)
    found, _ = E.fit(times, counts, start, epochs=600)
    np.testing.assert_allclose(found, q, atol=2e-2)
    for mode in ("stationary_reversible", "pande", "default"):
        np.testing.assert_allclose(E.fit(times, counts, start, mode=mode, epochs=600)[0], q, atol=5e-2)
    slow = [E.fit(times, counts, start, epochs=n, rate=1.0, optimizer="sgd")[1] for n in (1, 50)]
    assert slow[1] < slow[0]
    fixed, _ = E.fit(times, counts, start, pi=pi, epochs=300)
    np.testing.assert_allclose(L.stationary_distribution(fixed), pi, atol=1e-6)


def test_masks_hold_and_bad_starts_fail():
    mask = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1.0]])
    start = np.array([[-1.0, 1, 0], [1, -2, 1], [0, 1, -1]])
    found, _ = E.fit(np.array(POINTS), np.array(TOY, float), start, mask, epochs=50)
    assert found[0, 2] == found[2, 0] == 0
    with pytest.raises(ValueError, match="mask"):
        E.fit(np.array(POINTS), np.array(TOY, float), np.ones((3, 3)) - 3 * np.eye(3), mask)


def test_synthetic_counts(spark):
    q, _ = random_reversible(3, 5)
    got = R.synthetic_counts(spark, list("ABC"), q, [0.1, 1.0], 1000)
    assert {r.bucket for r in got.collect()} == {0, 1}
