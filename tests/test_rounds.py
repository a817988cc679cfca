"""What large families go through in rounds equals what small ones give as a group, on trees and contacts of every shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators import contraction as T
from strandmill.operators.cherries import encoded, fast_cherries, initial_categories, lengths_and_rates, state_counts
from strandmill.operators.contacts import maximal_matching
from strandmill.operators.likelihood import ancestral_states, pair_likelihood, tree_likelihood
from strandmill.operators.trees import leaf_pairs, leaf_pairs_in_rounds

NT = list("ACGT")
EDGES = "family string, parent string, child string, child_ord int, length double"
MSA = "family string, seq_name string, seq string"


def unequal():
    q = np.array([[0.0, 1, 5, 1], [1, 0, 1, 5], [5, 1, 0, 1], [1, 5, 1, 0]])
    return q / 7 - np.eye(4)


def one_way():
    """Not reversible."""
    q = np.roll(np.eye(4), 1, axis=1) + 0.1
    np.fill_diagonal(q, 0)
    return q - np.diag(q.sum(axis=1))


def chain(n):
    """A caterpillar: each inner node has a leaf and the next inner node."""
    return [x for k in range(n) for x in ((f"i{k}", f"l{k}"), (f"i{k}", f"i{k + 1}"))]


def path(n):
    return [(f"p{k}", f"p{k + 1}") for k in range(n)]


def star(n):
    return [("r", f"s{k}") for k in range(n)]


def random_tree(n, seed, wide):
    rng = np.random.default_rng(seed)
    return [(f"n{int(rng.integers(max(0, k - wide), k))}", f"n{k}") for k in range(1, n)]


SHAPES = {"chain": chain(60), "path": path(70), "star": star(50), "bushy": random_tree(120, 1, 120), "deep": random_tree(150, 2, 3), "two": [("a", "b"), ("a", "c")], "one": [("a", "b")]}


@pytest.fixture(scope="module")
def trees(spark):
    rng = np.random.default_rng(3)
    edges, seqs = [], []
    for family, pairs in SHAPES.items():
        order = {}
        for p, c in pairs:
            edges.append((family, p, c, order.setdefault(p, 0), float(rng.uniform(0.01, 0.8))))
            order[p] += 1
        for node in sorted({x for pair in pairs for x in pair}):
            if rng.random() < 0.9:  # some have no sequence
                seqs.append((family, node, "".join(rng.choice(list("ACGT-"), 70))))
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(seqs, MSA)


def near(got, want, columns, value):
    a, b = ({tuple(r[c] for c in columns): r[value] for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys()
    assert np.allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(("q", "leaves_only", "rated"), [(unequal(), True, True), (one_way(), False, False)], ids=["leaves, reversible, rates", "all nodes, one way"])
def test_likelihood_in_rounds(spark, trees, q, leaves_only, rated):
    edges, msa = trees
    sizes = msa.select("family").distinct()
    rates = sizes.select("family", F.transform(F.sequence(F.lit(0), F.lit(69)), lambda k: F.lit(0.25) + k % 3).alias("rates")) if rated else None
    want = tree_likelihood(edges, msa, NT, q, rates=rates, leaves_only=leaves_only)
    near(tree_likelihood(edges, msa, NT, q, rates=rates, leaves_only=leaves_only, whole=0, whole_edges=12), want, ["family", "site"], "ll")


def test_pairs_of_sites_in_rounds(spark, trees):
    edges, msa = trees
    both = [a + b for a in NT for b in NT]
    q = np.kron(unequal(), np.eye(4)) + np.kron(np.eye(4), unequal())
    contacts = spark.createDataFrame([(f, k, k + 9) for f in SHAPES for k in range(5)], "family string, i int, j int")
    near(pair_likelihood(edges, msa, contacts, both, q, whole=0, whole_edges=30), pair_likelihood(edges, msa, contacts, both, q), ["family", "i", "j"], "ll")


def test_parsimony_in_rounds(spark, trees):
    edges, msa = trees
    want = sorted(map(tuple, ancestral_states(edges, msa, NT).collect()))
    assert sorted(map(tuple, ancestral_states(edges, msa, NT, whole=0, whole_edges=12).collect())) == want


def test_pairs_of_leaves_in_rounds(spark, trees):
    edges, _ = trees
    near(leaf_pairs_in_rounds(edges), leaf_pairs(edges), ["family", "x", "y"], "t")
    near(leaf_pairs(edges, whole=60), leaf_pairs(edges), ["family", "x", "y"], "t")


def test_rounds_grow_with_the_logarithm(spark):
    for shape in (chain(1500), random_tree(3000, 5, 3000)):
        edges = spark.createDataFrame([("f", p, c) for p, c in shape], "family string, parent string, child string")
        assert len(T.contract(edges, 200).rounds) <= 24


def test_no_tree(spark):
    cycle = spark.createDataFrame([("f", str(k), str((k + 1) % 9), 0, 0.1) for k in range(9)], EDGES)
    msa = spark.createDataFrame([("f", "1", "ACGT")], MSA)
    with pytest.raises(Exception, match="cycle|one root"):
        tree_likelihood(cycle, msa, NT, unequal(), whole=0, whole_edges=1).collect()
    two = spark.createDataFrame([("f", p, c, 0, 0.1) for p, c in (("a", "b"), ("c", "d"))], EDGES)
    with pytest.raises(Exception, match="one root"):
        tree_likelihood(two, msa, NT, unequal(), whole=0).collect()
    none = spark.createDataFrame([], EDGES)
    assert tree_likelihood(none, msa, NT, unequal(), whole=0).count() == 0
    assert leaf_pairs_in_rounds(none).count() == 0


def plain_matching(pairs, distance):
    used, out = set(), []
    for i, j in sorted(set(pairs)):
        if j - i >= distance and not {i, j} & used:
            used |= {i, j}
            out.append((i, j))
    return out


def test_matching_in_rounds(spark):
    rng = np.random.default_rng(4)
    families = {
        "random": [tuple(sorted(x)) for x in rng.integers(0, 300, (2000, 2)).tolist()],
        "waiting": [(k, k + 7) for k in range(400)],  # each contact waits for the one before
        "hub": [(0, k) for k in range(7, 500)] + [(k, 900) for k in range(1, 600)],
        "few": [(1, 9), (9, 20)],
    }
    rows = [(f, i, j) for f, pairs in families.items() for i, j in pairs]
    contacts = spark.createDataFrame(rows + rows[:50], "family string, i long, j long")
    want = sorted((f, i, j) for f, pairs in families.items() for i, j in plain_matching(pairs, 7))
    for whole in (30, 1 << 18):
        assert sorted(map(tuple, maximal_matching(contacts, 7, whole).collect())) == want


def test_matching_of_points_makes_no_contacts(spark, monkeypatch):
    """Points, dense and far apart, as one group or by cells: what one scan of all contacts takes, without making them."""
    from strandmill.operators import contacts as K

    rng = np.random.default_rng(8)
    rows = [(f, int(k), *map(float, rng.normal(0, spread, 3))) for f, spread, n in (("dense", 0.1, 150), ("wide", 1.0, 150), ("one", 1.0, 1)) for k in rng.permutation(n)]
    rows += [("dense", 500, None, 0.0, 0.0), ("dense", None, 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "family string, site long, x double, y double, z double")
    want = []
    for family in ("dense", "wide"):
        own = sorted((r[1], r[2:]) for r in rows if r[0] == family and None not in r)
        near = [(a, b) for n, (a, p) in enumerate(own) for b, q in own[n + 1 :] if np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()) < 0.3]
        want += [(family, i, j) for i, j in plain_matching(near, 7)]
    twice = [*rows[:150], ("dense", 3, 9.0, 9.0, 9.0)]  # a site at two points is in contact by either
    assert sorted(map(tuple, K.matching_of_points(spark.createDataFrame(twice, atoms.schema), 0.3, 7).collect())) == sorted(w for w in want if w[0] == "dense")
    monkeypatch.setattr(K, "distance_contacts", None)
    assert sorted(map(tuple, K.matching_of_points(atoms, 0.3, 7).collect())) == want
    assert sorted(map(tuple, K.matching_of_points(atoms, 0.3, 7, whole=8).collect())) == want
    monkeypatch.setattr(K, "SLAB_SITES", 8)
    assert sorted(map(tuple, K.matching_of_points(atoms, 0.3, 7, whole=8).collect())) == want


def test_cherries_in_rounds(spark):
    rng = np.random.default_rng(6)
    base = rng.choice(NT, 40)
    rows = [("same", f"q{k}", "ACGT" * 10) for k in range(101)] + [("far", f"o{k}", "".join(rng.choice(NT, 40))) for k in range(80)]
    for k in range(121):
        s = base.copy()
        s[rng.integers(0, 40, k % 5)] = rng.choice(NT)
        rows.append(("close", f"c{k}", "".join(s)[: 40 - k % 3]))
    rows += [("far", "none", None), ("few", "x", "AC"), ("few", "y", "A")]
    msa = spark.createDataFrame(rows, MSA)
    edges, rates = fast_cherries(msa, NT, unequal(), n_rates=4, whole=100, whole_set=8)
    edges, rates = edges.collect(), {r.family: r.rates for r in rates.collect()}
    q = unequal()
    for family in ("same", "far", "close", "few"):
        names = [n for f, n, _ in rows if f == family]
        own = [e for e in edges if e.family == family]
        assert sorted(e.child for e in own if not e.child.startswith("internal-")) == sorted(names)
        tops = [e for e in own if e.child.startswith("internal-")]
        assert len(tops) == len(names) // 2 and sorted(e.child_ord for e in own if e.parent == "root") == list(range(-(-len(names) // 2)))
        assert np.isclose(np.mean(rates[family]), 1)
        # lengths and rates are those that the pairs give as a group
        seqs = {n: s for f, n, s in rows if f == family}
        width = max(len(s) for s in seqs.values() if s)
        pairs = [sorted((e.child_ord, e.child) for e in own if e.parent == f"internal-{k}") for k in range(len(tops))]
        first, second = (encoded([seqs[p[k][1]] for p in pairs], NT, width).astype(int) for k in (0, 1))
        from strandmill.functions.grid import grid, initial_rate_weights, log_gamma_prior, site_rate_grid
        from strandmill.functions.markov import expm_many

        values = np.array(site_rate_grid(4))
        logs = np.log(np.maximum(expm_many(q, np.outer(grid(), values).ravel()), 1e-300)).reshape(len(grid()), 4, 4, 4)
        logs = logs + np.swapaxes(logs, 2, 3)
        seen = state_counts(encoded(list(seqs.values()), NT, width), 4)
        lengths, category = lengths_and_rates(first, second, logs, initial_categories(seen, initial_rate_weights(list(values))), np.array([log_gamma_prior(r) for r in values]), 50)
        mean = values[category].mean()
        assert np.allclose(rates[family], values[category] / mean)
        got = [next(e.length for e in own if e.parent == f"internal-{k}") for k in range(len(tops))]
        assert np.allclose(got, [grid()[k] * mean / 2 for k in lengths])
    close = {e.child: e.parent for e in edges if e.family == "close"}
    assert len(set(close.values())) == 61


def test_places_by_ranges(spark, monkeypatch):
    from strandmill.functions import ranks

    monkeypatch.setattr(ranks, "RANGE_ROWS", 40)
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") % 3).alias("n"))
    got = ranks.with_before(rows, "v", "n").orderBy("v").collect()
    assert [r.before for r in got] == [sum(x.n for x in got[:k]) for k in range(500)]
    placed = ranks.with_position(rows.select("v"), "v").orderBy("v").collect()
    assert [r.position for r in placed] == list(range(500))
    assert ranks.with_before(rows.limit(0), "v", "n").count() == 0
