"""Models of sites, comparisons of models and operators on columns against plain versions."""

import itertools

import numpy as np
import pytest

from strandmill.functions import markov as L
from strandmill.functions.ranks import values_at, with_before
from strandmill.operators import alignments as M
from strandmill.operators import fitting as E
from strandmill.operators import rates as R
from strandmill.operators import sites as S
from strandmill.plans import pipelines as P

NT = list("ACGT")


def equal(n=4):
    q = np.full((n, n), 1 / (n - 1))
    np.fill_diagonal(q, -1)
    return q


def some_counts(rng, sites, buckets, n=4):
    return rng.integers(0, 9, (sites, buckets, n, n)).astype(float)


def test_sites_fitted_together_are_those_fitted_alone():
    rng = np.random.default_rng(1)
    times, counts = np.array([0.1, 0.5, 2.0]), some_counts(rng, 5, 3)
    counts[3] = 0
    start = np.stack([equal() * r for r in (0.5, 1, 2, 1.5, 1)])
    q, loss = E.fit_many(times, counts, start, epochs=40)
    for k in (0, 1, 2, 4):
        alone, its_loss = E.fit(times, counts[k], start[k], epochs=40)
        np.testing.assert_allclose(q[k], alone, atol=1e-6)
        assert loss[k] == pytest.approx(its_loss, abs=1e-9)
    np.testing.assert_allclose(q[3], start[3], atol=1e-9)


def test_gradients_of_many_sites():
    rng = np.random.default_rng(2)
    times, counts = np.array([0.2, 1.0]), some_counts(rng, 3, 2)
    model = E.WeightedMatrices(np.stack([equal(), 2 * equal(), equal()]))
    model.theta = model.theta + rng.normal(size=model.theta.shape) * 0.3

    def loss():
        q = model.value()
        return E.losses_and_gradients(q, model.pi, times, counts)[0]

    q = model.value()
    g = model.gradient(E.losses_and_gradients(q, model.pi, times, counts)[1])
    for k, i in itertools.product(range(3), range(model.theta.shape[1])):
        was = model.theta[k, i]
        model.theta[k, i] = was + 1e-5
        up = loss()[k]
        model.theta[k, i] = was - 1e-5
        down = loss()[k]
        model.theta[k, i] = was
        assert g[k, i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_optimizers_agree():
    rng = np.random.default_rng(3)
    times, counts = np.array([0.1, 0.5, 2.0]), some_counts(rng, 1, 3)[0] + 50 * np.eye(4)
    adam, a = E.fit(times, counts, equal(), epochs=1500, rate=0.05)
    quasi, b = E.fit(times, counts, equal(), epochs=200, optimizer="lbfgs")
    assert b <= a + 1e-6
    np.testing.assert_allclose(adam, quasi, atol=1e-2)


def test_likelihood_of_transitions_under_site_models(spark):
    rng = np.random.default_rng(4)
    qs = []
    for _ in range(70):  # more than one block of sites
        e = rng.gamma(1, 1, (4, 4)) + 0.1
        q = (e + e.T) * rng.dirichlet(np.ones(4) * 5)
        np.fill_diagonal(q, 0)
        qs.append(q - np.diag(q.sum(axis=1)))
    models = spark.createDataFrame([("f", s, a, b, float(q[i, j])) for s, q in enumerate(qs) for i, a in enumerate(NT) for j, b in enumerate(NT)], "family string, site int, x string, y string, q double")
    seqs = ["".join(rng.choice(list("ACGT-"), 70)) for _ in range(6)]
    rows = [("f", k, seqs[k], seqs[k + 1], 0.1 * (k + 1)) for k in range(5)] + [("g", 9, "A", "C", 1.0)]
    frame = spark.createDataFrame(rows, "family string, tid int, x_seq string, y_seq string, t double")
    for gap in (None, "T"):
        got = {(r.tid, r.site): r.ll for r in S.site_model_likelihood(frame, models, NT, gap).collect()}
        want = {}
        for _, k, x, y, t in rows[:5]:
            for s, (a, b) in enumerate(zip(x, y)):
                if a in NT and b in NT:
                    p = L.expm(qs[s] * t)
                    p = L.given_no_gap(p) if gap else p
                    want[k, s] = np.log(p[NT.index(a), NT.index(b)])
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    by = {r.tid: r for r in S.by_transition(S.site_model_likelihood(frame, models, NT)).collect()}
    assert by[0].ll == pytest.approx(sum(by[0].lls))


def test_models_are_compared_on_families_all_have(spark):
    frame = lambda rows: spark.createDataFrame(rows, "family string, ll double, n_sites long, ll_per_site double")
    found = P.compare_models({"a": frame([("f", -10.0, 4, -2.5), ("g", -6.0, 2, -3.0), ("h", -1.0, 1, -1.0)]), "b": frame([("f", -8.0, 4, -2.0), ("g", -7.0, 2, -3.5)])}, "a").persist()
    got = {(r.family, r.model): (r.ll, r.gain, r.gain_per_site) for r in found.collect()}
    assert got == {("f", "a"): (-10, 0, 0), ("f", "b"): (-8, 2, 0.5), ("g", "a"): (-6, 0, 0), ("g", "b"): (-7, -1, -0.5)}
    gains = [r.gain for r in P.information_gain(found, "b", 9, 6, 20).collect()]
    assert len(gains) == 20 and set(gains) <= {2 * s - 6 for s in (4, 1, -2)}


def test_independent_pairs_are_as_likely_as_their_sites(spark):
    edges = spark.createDataFrame([("f", "r", c, k, 0.1 + k / 10) for k, c in enumerate("abc")], "family string, parent string, child string, child_ord int, length double")
    msa = spark.createDataFrame([("f", "a", "ACGTA"), ("f", "b", "ACTTA"), ("f", "c", "GCTT-")], "family string, seq_name string, seq string")
    near = spark.createDataFrame([("f", 0, 3), ("f", 1, 4)], "family string, i int, j int")
    q = equal()
    single, both = P.evaluate(edges, msa, NT, q).first(), P.evaluate_pairs(edges, msa, near, NT, q, P.independent_pairs(q)[0], 2).first()
    assert both.ll == pytest.approx(single.ll) and both.n_sites == single.n_sites == 5


def test_states_traded_between_columns(spark):
    rng = np.random.default_rng(5)
    msa = [("f", k, "".join(rng.choice(list("ATC-"), 9))) for k in range(40)] + [("g", 1, "AT"), ("g", 2, "TA"), ("h", 3, "")]
    want = {}
    for f in "fg":
        seqs = [s for g, _, s in msa if g == f]
        for i, j in itertools.combinations(range(len(seqs[0])), 2):
            both = [s[i] + s[j] for s in seqs if s[i] in "AT" and s[j] in "AT"]
            shares = [both.count(x) / len(both) if both else 0 for x in ("AT", "TA", "AA", "TT")]
            if len(both) >= len(seqs) / 8 and shares[0] > 0.2 and shares[1] > 0.2:
                want[f, i, j] = (*shares, len(both))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in M.site_pair_cooccurrence(spark.createDataFrame(msa, "family string, seq_name long, seq string"), "A", "T").collect()}
    assert got.keys() == want.keys() and len(want) > 3
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_distances_of_packed_sequences(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIRED", 7)
    rng = np.random.default_rng(6)
    states = list("ACDEFGHIK")
    msa = [("f", k, "".join(rng.choice([*states, "-", "x"], n))) for k, n in enumerate([150] * 20 + [130, 3, 0])] + [("g", 1, "A"), ("g", 2, "C")]
    got = {tuple(r)[:3]: r.distance for r in M.hamming_pairs(spark.createDataFrame(msa, "family string, seq_name long, seq string"), states).collect()}
    want = {}
    for (f, x, a), (g, y, b) in itertools.combinations(msa, 2):
        if f == g:
            both = [(p, q) for p, q in zip(a, b) if p in states and q in states]
            want[f, x, y] = sum(p != q for p, q in both) / len(both) if both else 0.0
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_rate_categories_follow_the_walk(spark):
    weights = __import__("strandmill.functions.grid", fromlist=["x"]).initial_rate_weights
    rates = [0.05, 0.2, 0.4, 1.0, 3.0, 9.0]
    rows = [("f", k, (k * 7) % 23) for k in range(57)] + [("g", 0, 1)]
    got = {(r.family, r.site): r.category for r in M.initial_rate_categories(spark.createDataFrame(rows, "family string, site int, variability long"), rates).collect()}
    for f in "fg":
        own = sorted((v, s) for g, s, v in rows if g == f)
        now = 0
        for rank, (_, s) in enumerate(own):
            if now < len(rates) - 1 and rank >= np.floor(weights(rates)[now] * len(own) + 0.5):
                now += 1
            assert got[f, s] == now


def test_places_and_quantiles_over_ranges(spark, monkeypatch):
    from strandmill.functions import ranks

    monkeypatch.setattr(ranks, "RANGE_ROWS", 20)
    rng = np.random.default_rng(7)
    values = rng.integers(0, 300, 1000).astype(float) / 4
    v, n = np.unique(values, return_counts=True)
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n)], "v double, n long").repartition(5)
    ordered = with_before(frame, "v", "n").persist()
    assert {r.v: r.before for r in ordered.collect()} == dict(zip(v, np.cumsum(n) - n))
    places = [0, 99.5, 499.25, 999]
    assert values_at(ordered, "v", "n", places) == pytest.approx([np.quantile(values, p / 999) for p in places])
    rows = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
    got = sorted(tuple(r) for r in M.quantile_bins(rows, "v", 4).collect())
    cuts = np.quantile(values, [0.25, 0.5, 0.75])
    at = np.searchsorted(cuts, values, "left")
    for k, n, mean, low, high in got:
        own = values[at == k]
        assert (n, mean, low, high) == pytest.approx((len(own), own.mean(), np.quantile(own, 0.25), np.quantile(own, 0.75)))
    assert M.quantile_bins(rows.limit(0), "v", 4).count() == 0


def test_errors_by_entry_and_probabilities(spark):
    a, b = (spark.createDataFrame([("A", "A", -x), ("A", "B", x), ("B", "A", 1.0), ("B", "B", -1.0)], "x string, y string, q double") for x in (1.0, 4.0))
    assert {(r.x, r.y): r.error for r in R.relative_errors(a, b).collect()} == {("A", "B"): 3.0, ("B", "A"): 0.0}
    p = {(r.x, r.y): r.p for r in R.transition_probabilities(a, 0.5).collect()}
    assert p["A", "B"] == pytest.approx((1 - np.exp(-1)) / 2)
    assert R.block(a, ["A"]).count() == 1


def test_side_atoms_stand_off_the_backbone(spark, tmp_path):
    rng = np.random.default_rng(8)
    lines, want = [], []
    for k in range(12):
        at = {a: rng.uniform(-8, 8, 3).round(3) for a in ("N", "CA", "C")}
        for a, p in at.items():
            lines.append(f"ATOM  {k:5d}  {a:<3} GLY A{k + 5:4d}    {p[0]:8.3f}{p[1]:8.3f}{p[2]:8.3f}")
        along = (at["N"] - at["CA"]) / np.linalg.norm(at["N"] - at["CA"])
        up = np.cross(at["N"] - at["C"], along)
        up /= np.linalg.norm(up)
        want.append(at["CA"] + 1.522 * (np.cos(1.927) * along + np.sin(1.927) * np.cos(-2.143) * np.cross(up, along) - np.sin(1.927) * np.sin(-2.143) * up))
    lines.append("ATOM     99  N   GLY B   1       0.000   0.000   0.000")  # no other atoms: no site
    (tmp_path / "pdb").mkdir()
    (tmp_path / "pdb" / "f.pdb").write_text("\n".join(lines) + "\n")
    from strandmill.operators import contacts as K
    from strandmill.sources import formats as F

    backbone = F.read_backbone(spark, str(tmp_path / "pdb"))
    got = {r.site: (r.x, r.y, r.z) for r in K.side_atoms(backbone).collect()}
    assert len(got) == 12
    for k, p in enumerate(want):
        np.testing.assert_allclose(got[k], p, atol=1e-6)
    near = {(r.i, r.j) for r in K.backbone_contacts(backbone, 8.0).collect()}
    assert near == {(i, j) for i in range(12) for j in range(12) if np.linalg.norm(want[i] - want[j]) < 8}


def test_matrix_formats_round_trip(spark):
    from strandmill.sources import formats as F

    rng = np.random.default_rng(9)
    e, pi = rng.gamma(2, 1, (4, 4)), rng.dirichlet(np.ones(4) * 9)
    q = (e + e.T) * pi
    np.fill_diagonal(q, 0)
    q -= np.diag(q.sum(axis=1))
    back, probs = F.from_paml_text(F.paml_text(NT, q, pi), NT)
    np.testing.assert_allclose(back, q, rtol=1e-8)
    np.testing.assert_allclose(probs, pi, rtol=1e-8)
    assert -np.dot(probs, np.diag(F.from_paml_text(F.paml_text(NT, q, pi), NT, 1.0)[0])) == pytest.approx(1)
    text = F.xrate_text(NT, q, pi)
    assert text.count("(") == text.count(")")
    np.testing.assert_allclose(F.from_xrate_text(text, NT), q, rtol=1e-12)
    with pytest.raises(ValueError, match="do not make"):
        F.from_paml_text("1 2", NT)


def test_a_stockholm_text_for_each_rate(spark):
    from strandmill.sources import formats as F

    edges = spark.createDataFrame([("f", "r", "a", 0, 1.0), ("f", "r", "b", 1, 2.0)], "family string, parent string, child string, child_ord int, length double")
    msa = spark.createDataFrame([("f", "a", "ACG"), ("f", "b", "x-T")], "family string, seq_name string, seq string")
    rates = spark.createDataFrame([("f", 0, 2.0), ("f", 1, 0.5), ("f", 2, 2.0)], "family string, site int, rate double")
    got = {r.family: r.text for r in F.stockholm_by_rate(msa, edges, rates, NT).collect()}
    assert got == {
        "f_0": "# STOCKHOLM 1.0\n#=GF NH (f_0-a:0.5,f_0-b:1)f_0-r;\nf_0-a C\nf_0-b *\n//\n",
        "f_1": "# STOCKHOLM 1.0\n#=GF NH (f_1-a:2,f_1-b:4)f_1-r;\nf_1-a AG\nf_1-b *T\n//\n",
    }


def test_site_models_by_edges_use_inner_sequences(spark):
    edges = spark.createDataFrame([("f", "r", "u", 0, 0.5), ("f", "r", "c", 1, 0.5), ("f", "u", "a", 0, 0.5), ("f", "u", "b", 1, 0.5)], "family string, parent string, child string, child_ord int, length double")
    msa = spark.createDataFrame([("f", n, s) for n, s in {"a": "AA", "b": "AC", "c": "AG"}.items()], "family string, seq_name string, seq string")
    found = P.learn_site_specific(msa, NT, equal(), edges, epochs=30, strategy="edge").toPandas()
    out = -found[found.x == found.y].groupby("site").q.sum()
    assert len(found) == 32 and out[0] < out[1]  # the first site never changes


def test_families_and_sites_are_chosen(spark):
    rng = np.random.default_rng(10)
    msa = spark.createDataFrame([(f, f"{f}{k}", "".join(rng.choice(NT, 30))) for f in "fgh" for k in range(6)], "family string, seq_name string, seq string")
    sites = spark.createDataFrame([(f, k, 2 * k) for f in "fgh" for k in range(10)], "family string, k int, site int")
    how = P.Settings(epochs=5, families=["f", "g"], optimizer="lbfgs", mode="stationary_reversible", first=equal())
    q = P.dense(P.learn_rate_matrix(msa, NT, how, sites), NT)[1]
    np.testing.assert_allclose(q.sum(axis=1), 0, atol=1e-9)
    assert (q[~np.eye(4, dtype=bool)] > 0).all()
