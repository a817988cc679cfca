import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import TREE, edge_rows
from strandmill.functions import markov as L
from strandmill.functions.grid import grid
from strandmill.operators import alignments as M
from strandmill.operators import contacts as K
from strandmill.operators import likelihood as H
from strandmill.operators import trees as T
from strandmill.operators.cherries import fast_cherries, pair_sequences
from strandmill.plans import pipelines as P
from strandmill.streaming import counts as stream

NT = list("ACGT")


def equal(n=4):
    q = np.full((n, n), 1 / (n - 1))
    np.fill_diagonal(q, -1)
    return q


def tree_frame():
    return pd.DataFrame(list(edge_rows("f", TREE)), columns=["family", "parent", "child", "child_ord", "length"])


def brute_likelihood(seqs, q, pi):
    """Sums over all states of all nodes."""
    nodes = sorted({x for p, c, _ in TREE for x in (p, c)})
    p = {t: L.expm(q * t) for *_, t in TREE}
    out = []
    for site in range(len(next(iter(seqs.values())))):
        total = 0
        for states in itertools.product(range(len(pi)), repeat=len(nodes)):
            at = dict(zip(nodes, states))
            if any(s[site] in NT and NT.index(s[site]) != at[n] for n, s in seqs.items()):
                continue
            total += pi[at["internal-0"]] * np.prod([p[t][at[a], at[b]] for a, b, t in TREE])
        out.append(np.log(total))
    return out


def test_pruning_sums_over_unknown_states():
    seqs = {"seq1": "AC-", "seq2": "AGT", "seq3": "TCX"}
    q = L.normalized(np.array([[-3.0, 1, 1, 1], [2, -4, 1, 1], [2, 1, -4, 1], [2, 1, 1, -4]]))
    pi = L.stationary_distribution(q)
    got = H.pruning(tree_frame(), seqs, NT, q, pi, np.ones(3))
    np.testing.assert_allclose(got, brute_likelihood(seqs, q, pi), rtol=1e-9)


def test_tree_likelihood_by_family(spark):
    msa = spark.createDataFrame([("f", n, s) for n, s in {"seq1": "AC", "seq2": "AG", "seq3": "TC"}.items()], "family string, seq_name string, seq string")
    edges = spark.createDataFrame(tree_frame())
    rates = spark.createDataFrame([("f", [1.0, 1.0])], "family string, rates array<double>")
    one = {r.site: r.ll for r in H.tree_likelihood(edges, msa, NT, equal()).collect()}
    two = {r.site: r.ll for r in H.tree_likelihood(edges, msa, NT, equal(), rates=rates).collect()}
    assert one.keys() == two.keys() == {0, 1} and all(one[k] == pytest.approx(two[k]) for k in one)
    assert P.evaluate(edges, msa, NT, equal()).first().ll == pytest.approx(sum(one.values()))


def test_pairs_of_independent_sites_add_up(spark):
    edges = spark.createDataFrame(tree_frame())
    seqs = {"seq1": "AC-", "seq2": "AGT", "seq3": "TCA"}
    msa = spark.createDataFrame([("f", n, s) for n, s in seqs.items()], "family string, seq_name string, seq string")
    near = spark.createDataFrame([("f", 0, 2)], "family string, i int, j int")
    q = L.normalized(np.array([[-3.0, 1, 1, 1], [2, -4, 1, 1], [2, 1, -4, 1], [2, 1, 1, -4]]))
    both, pi = P.independent_pairs(q)
    got = H.pair_likelihood(edges, msa, near, [a + b for a in NT for b in NT], both, pi).collect()
    one = {r.site: r.ll for r in H.tree_likelihood(edges, msa, NT, q).collect()}
    assert [(r.i, r.j) for r in got] == [(0, 2)] and got[0].ll == pytest.approx(one[0] + one[2])
    with pytest.raises(ValueError, match="more than one"):
        H.pair_likelihood(edges, msa, near.union(spark.createDataFrame([("f", 2, 1)], near.schema)), [a + b for a in NT for b in NT], both, pi)


def test_parsimony_is_least():
    rng = np.random.default_rng(2)
    for _ in range(10):
        seqs = {n: "".join(rng.choice([*NT, "-"], 1)) for n in ("seq1", "seq2", "seq3")}
        found, changes = H.parsimony(tree_frame(), seqs, NT)
        assert sum(found[p] != found[c] for p, c, _ in TREE) == changes
        inner = ["internal-0", "internal-1", "internal-2"]
        free = [n for n, s in seqs.items() if s == "-"]
        best = min(sum({**seqs, **dict(zip(inner + free, pick))}[p] != {**seqs, **dict(zip(inner + free, pick))}[c] for p, c, _ in TREE) for pick in itertools.product(NT, repeat=3 + len(free)))
        assert changes == best


def test_simulation_follows_the_model(spark):
    q = np.array([[-1.0, 1], [3, -3]])
    edges = spark.createDataFrame(list(edge_rows("f", TREE)), "family string, parent string, child string, child_ord int, length double")
    sim = H.simulate(edges, 4000, ["S", "T"], q)
    rows = {r.seq_name: r.seq for r in sim.collect()}
    assert rows == {r.seq_name: r.seq for r in H.simulate(edges, 4000, ["S", "T"], q).collect()}
    for s in rows.values():
        assert s.count("S") / 4000 == pytest.approx(0.75, abs=0.04)


def test_pairing_is_a_partition():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 31):
        codes = rng.integers(-1, 4, (n, 12))
        pairs, odd = pair_sequences(codes, rng)
        used = [i for p in pairs for i in p] + ([] if odd is None else [odd])
        assert sorted(used) == list(range(n)) and len(pairs) == n // 2
    same = np.zeros((3000, 4), np.int64)
    assert len(pair_sequences(same, rng)[0]) == 1500


def test_fast_cherries_finds_close_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(6):
        a = rng.integers(0, 4, 200)
        b = np.where(rng.random(200) < 0.03, rng.integers(0, 4, 200), a)
        rows += [("f", f"s{k}a", "".join(NT[c] for c in a)), ("f", f"s{k}b", "".join(NT[c] for c in b))]
    edges, rates = fast_cherries(spark.createDataFrame(rows, "family string, seq_name string, seq string"), NT, equal())
    pairs = {frozenset((r.x[:2], r.y[:2])) for r in T.cherries(edges).collect()}
    assert pairs == {frozenset((f"s{k}",)) for k in range(6)}
    assert np.mean(rates.first().rates) == pytest.approx(1)
    assert all(r.t < 0.2 for r in T.cherries(edges).collect())


def test_learning_from_simulated_alignments(spark):
    q = L.normalized(np.array([[-1.0, 0.6, 0.2, 0.2], [0.6, -1.0, 0.2, 0.2], [0.2, 0.2, -1.0, 0.6], [0.2, 0.2, 0.6, -1.0]]))
    star = [e for f in range(4) for k in range(8) for e in ((f"f{f}", "root", f"n{k}", k, 0.5), (f"f{f}", f"n{k}", f"l{k}a", 0, 0.1), (f"f{f}", f"n{k}", f"l{k}b", 1, 0.1))]
    edges = spark.createDataFrame(star, "family string, parent string, child string, child_ord int, length double")
    msa = H.simulate(edges, 500, NT, q, seed=5).where("seq_name like 'l%'").persist()
    rates = spark.createDataFrame([(f"f{k}", [1.0] * 500) for k in range(4)], "family string, rates array<double>")
    known = P.Settings(strategy="cherry", estimator=P.given_trees(edges, rates), epochs=150)
    got = L.dense(P.learn_rate_matrix(msa, NT, known), NT)[1]
    np.testing.assert_allclose(got, q, atol=0.15)


def test_site_specific_models_keep_silent_sites(spark):
    edges = spark.createDataFrame(list(edge_rows("f", TREE)), "family string, parent string, child string, child_ord int, length double")
    msa = spark.createDataFrame([("f", n, s) for n, s in {"seq1": "A-", "seq2": "A-", "seq3": "T-"}.items()], "family string, seq_name string, seq string")
    found = P.learn_site_specific(msa, NT, equal(), edges, epochs=3).toPandas()
    assert set(found.site) == {0, 1} and len(found) == 32
    silent = found[found.site == 1].set_index(["x", "y"]).q
    assert silent["A", "C"] / -silent["A", "A"] == pytest.approx(1 / 3)


def test_matching_and_distance_contacts(spark):
    c = spark.createDataFrame([("f", i, j) for i in range(6) for j in range(6)], "family string, i int, j int")
    got = sorted((r.i, r.j) for r in K.maximal_matching(c, 2).collect())
    assert got == [(0, 2), (1, 3)]
    rng = np.random.default_rng(0)
    at = rng.uniform(0, 20, (60, 3))
    atoms = spark.createDataFrame([("f", k, *map(float, p)) for k, p in enumerate(at)], "family string, site int, x double, y double, z double")
    near = {(r.i, r.j) for r in K.distance_contacts(atoms, 6.0).collect()}
    assert near == {(i, j) for i in range(60) for j in range(i + 1, 60) if np.linalg.norm(at[i] - at[j]) < 6}


def test_alignment_operators_on_gaps_and_empties(spark):
    msa = spark.createDataFrame([("f", 1, "A-CG"), ("f", 2, "AACC"), ("g", 3, "----")], "family string, seq_name long, seq string")
    assert M.dataset_stats(msa).first().asDict() == {"n_families": 2, "n_sequences": 3, "n_sites": 8, "n_residues": 7}
    assert M.dataset_stats(msa.limit(0)).first().n_sequences == 0
    v = {(r.family, r.site): r.variability for r in M.site_variability(msa, NT).collect()}
    assert v[("f", 3)] == 2 and v[("g", 0)] == 0
    d = M.hamming_pairs(msa, NT).first()
    assert d.distance == pytest.approx(1 / 3)
    assert M.without_prefix(msa.withColumn("seq_name", F.lit("internal-1"))).count() == 0


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    events = [(k, f"2024-01-{1 + k // 4:02d} 0{k % 4}:00:00", k % 3, "abc"[k * 7 % 3]) for k in range(60)]
    df = spark.createDataFrame(events, "event_id long, s string, user_id long, event_type string").select("event_id", F.to_timestamp("s").alias("ts"), "user_id", "event_type")
    df.repartition(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = stream.run_available(stream.transitions(live), "append", str(tmp_path / "run")).toPandas()
    assert len(got) == 57
    pairs = spark.createDataFrame(got)
    from strandmill.operators.counts import count_states

    assert count_states(pairs, grid()).agg(F.sum("n")).first()[0] == 57
