"""Write, then read: the same rows, for every format."""

import pytest
from pyspark.sql import functions as F

from fixtures import TREE, edge_rows
from strandmill.operators import alignments as M
from strandmill.plans import cache
from strandmill.sources import formats as S


def rows(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def again(texts, tmp_path):
    S.write_files(texts, str(tmp_path / "out"))
    return str(tmp_path / "out")


MSA = [("fam1", "b", "AC-"), ("fam1", "a", "GGT"), ("0012", "x", "TT"), ("odd name+100%", "y", "A")]


def test_alignments(spark, tmp_path):
    msa = spark.createDataFrame(MSA, "family string, seq_name string, seq string")
    assert rows(S.read_msa(spark, again(S.msa_text(msa), tmp_path))) == sorted(MSA)
    for path in (tmp_path / "out").glob("family=*/part-*"):
        text = path.read_text()
        assert text.endswith("\n") and not text.endswith("\n\n") and "\0" not in text
    assert rows(S.read_phylip(spark, again(S.phylip_text(msa), tmp_path))) == sorted(MSA)


def test_trees(spark, tmp_path):
    edges = spark.createDataFrame([*edge_rows("f", TREE), *edge_rows("g", TREE)], "family string, parent string, child string, child_ord int, length double")
    assert rows(S.read_tree(spark, again(S.tree_text(edges), tmp_path))) == rows(edges)


def test_numbers(spark, tmp_path):
    rates = spark.createDataFrame([("f", 0, 0.5), ("f", 1, 1.0), ("f", 2, 2.25), ("g", 0, 1e-9)], "family string, site int, rate double")
    assert rows(S.read_site_rates(spark, again(S.numbers_text(rates, "site", "rate"), tmp_path))) == rows(rates)
    subset = spark.createDataFrame([("f", 0, 5), ("f", 1, 7), ("f", 2, 11)], "family string, k int, site int")
    assert rows(S.read_sites_subset(spark, again(S.numbers_text(subset, "k", "site"), tmp_path))) == rows(subset)
    near = spark.createDataFrame([("f", 0, 0), ("f", 1, 0), ("f", 0, 1)], "family string, i int, j int")
    sizes = spark.createDataFrame([("f", 2), ("g", 1)], "family string, n_sites int")
    assert rows(S.read_contact_map(spark, again(S.contact_map_text(near, sizes), tmp_path))) == rows(near)


def test_matrices_and_distributions(spark, tmp_path):
    q = spark.createDataFrame([("A", "A", -1.5), ("A", "NA", 1.5), ("NA", "A", 0.25), ("NA", "NA", -0.25)], "x string, y string, q double")
    named = lambda texts: texts.withColumn("family", F.lit("m"))
    assert rows(S.read_matrix(spark, again(named(S.matrix_text(q)), tmp_path)).drop("family")) == rows(q)
    pi = spark.createDataFrame([("A", 0.125), ("NA", 0.875)], "state string, prob double")
    assert rows(S.read_distribution(spark, again(named(S.distribution_text(pi)), tmp_path)).drop("family")) == rows(pi)


def test_transitions_and_likelihoods(spark, tmp_path):
    tr = spark.createDataFrame([("f", 0, "AC", "GC", 0.5), ("f", 1, "A", "T", 1.0)], "family string, tid int, x string, y string, t double")
    assert rows(S.read_transitions(spark, again(S.transitions_text(tr), tmp_path))) == rows(tr)
    ll = spark.createDataFrame([("f", k, -1.5 * k) for k in range(12)], "family string, tid int, ll double")
    assert rows(S.read_transition_likelihoods(spark, again(S.transition_likelihoods_text(ll), tmp_path))) == rows(ll)
    lls = spark.createDataFrame([("f", 0, [-1.0, -0.5]), ("f", 1, [-2.0])], "family string, tid int, lls array<double>")
    assert rows(S.read_transition_likelihoods(spark, again(S.transition_likelihoods_text(lls), tmp_path), True)) == rows(lls)
    total = spark.createDataFrame([("f", -3.5, [-1.5, -2.0]), ("g", -1.25, None)], "family string, total double, sites array<double>")
    got = S.read_log_likelihood(spark, again(S.log_likelihood_text(total), tmp_path))
    assert {r.family: (r.total, r.sites) for r in got.collect()} == {"f": (-3.5, [-1.5, -2.0]), "g": (-1.25, None)}
    ch = spark.createDataFrame([("f", 0, "a", "b", 0.5), ("f", 1, "c", "d", 1.5)], "family string, k int, x string, y string, t double")
    assert rows(S.read_cherries(spark, again(S.cherries_text(ch), tmp_path))) == rows(ch)
    S.write_files(spark.createDataFrame([("f", "3 transitions\n-1\n")], "family string, text string"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="wrong number"):
        S.read_transition_likelihoods(spark, str(tmp_path / "bad")).collect()


def test_rates_of_a_subset_of_sites(spark):
    rates = spark.createDataFrame([("f", [0.5, 1.0, 2.0])], "family string, rates array<double>")
    subset = spark.createDataFrame([("f", 0, 2), ("f", 1, 0)], "family string, k int, site int")
    assert M.site_subset_rates(rates, subset).first().rates == [2.0, 0.5]


def test_results_are_made_anew_when_rows_change(spark, tmp_path):
    calls = []
    make = lambda d: lambda: calls.append(1) or d.selectExpr("v * 2 AS v")
    one, two = (spark.createDataFrame([("a", v), ("b", 2)], "family string, v int") for v in (1, 5))
    for d in (one, one, two):
        got = cache.cached(spark, str(tmp_path), "op", make(d), d, a=1)
        assert rows(got) == sorted((2 * r.v,) for r in d.collect())
    assert len(calls) == 2
    for d in (one, two):
        got = cache.cached_by_family(spark, str(tmp_path), "fam", d, lambda x: x.selectExpr("family", "v * 2 AS w"), a=1)
        assert rows(got.select("family", "w")) == sorted((r.family, 2 * r.v) for r in d.collect())
