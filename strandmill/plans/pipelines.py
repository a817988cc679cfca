"""End-to-end estimation: from alignments (and trees, if there are any) to rate matrices, and their evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.grid import grid
from strandmill.functions.markov import chain_product, dense, normalized, stationary_distribution
from strandmill.operators import contacts as K
from strandmill.operators import counts as C
from strandmill.operators import rates as R
from strandmill.operators.alignments import site_subset, site_subset_rates
from strandmill.operators.cherries import fast_cherries
from strandmill.operators.expectation import learn_by_expectation
from strandmill.operators.fitting import learn_from_counts
from strandmill.operators.likelihood import ancestral_states, pair_likelihood, tree_likelihood
from strandmill.operators.sites import by_transition, estimate_site_rates, learn_site_models, site_model_likelihood
from strandmill.operators.trees import pairs
from strandmill.sources.formats import files, from_paml_text, read_matrix

#: (alignments, states, matrix) -> (edges, site rates): estimators of trees by name.
TreeEstimator = Callable[[DataFrame, list[str], np.ndarray], tuple[DataFrame, DataFrame]]
TREE_ESTIMATORS: dict[str, TreeEstimator] = {"fast_cherries": lambda msa, states, q: fast_cherries(msa, states, q)}


def estimator(s: Settings) -> TreeEstimator:
    """The settings' estimator of trees."""
    if callable(s.estimator):
        return s.estimator
    if s.estimator == "fast_cherries":
        return lambda msa, states, q: fast_cherries(msa, states, q, s.points, s.categories)
    if s.estimator == "gt":
        if s.given is None:
            raise ValueError("estimator gt passes on given trees and rates, of which there are none")
        return given_trees(*s.given)
    if s.estimator not in TREE_ESTIMATORS:
        raise ValueError(f"no estimator {s.estimator}; there are {sorted([*TREE_ESTIMATORS, 'gt'])}")
    return TREE_ESTIMATORS[s.estimator]


def given_trees(edges: DataFrame, rates: DataFrame) -> TreeEstimator:
    """An estimator that passes known trees and rates on."""
    return lambda msa, states, q: (edges, rates)


@dataclass
class Settings:
    """What learning a matrix takes besides its data."""

    strategy: str = "cherry++"
    points: list[float] = field(default_factory=grid)
    #: A name of TREE_ESTIMATORS, gt for the trees and rates that are given, or an estimator.
    estimator: str | TreeEstimator = "fast_cherries"
    given: tuple[DataFrame, DataFrame] | None = None
    initial: str = "jtt-ipw"
    iterations: int = 1
    epochs: int = 200
    rate: float = 0.1
    distance: int = 7
    mode: str = "pande_reversible"
    #: One of fitting.OPTIMIZERS, or em for expectation and maximisation.
    optimizer: str = "adam"
    categories: int = 20
    #: The matrix that the first trees are estimated with; equal rates where it is not given.
    first: np.ndarray | None = None
    #: Families that are used; all where none are named.
    families: list[str] | None = None
    #: Whether contacts are cut to a matching, so that a site is in one pair at most.
    matching: bool = True


def _equal(n: int) -> np.ndarray:
    q = np.full((n, n), 1 / (n - 1))
    np.fill_diagonal(q, -1.0)
    return q


def named_matrix(spark: SparkSession, name: str, states: list[str], rate: float | None = None) -> DataFrame:
    """(x, y, q): equ (all changes equally likely), equ_x_equ (two such sites side by side), or the matrix of a file.

    A file is a table of rates with states as head, or a lower triangle of exchangeabilities with the stationary
    distribution (PAML's layout, as published for WAG, LG, JTT and others), whose order of states is that of `states`.
    rate: the mutation rate that it is scaled to.
    """
    if name == "equ":
        found = R.equal_rates(spark, states)
    elif name == "equ_x_equ":
        letters = list(dict.fromkeys(x[0] for x in states))
        found = R.chain_product(R.equal_rates(spark, letters), R.equal_rates(spark, letters))
    else:
        text = files(spark, name).select("text").first()
        if text is None:
            raise ValueError(f"no matrix {name}")
        if any(c.isalpha() for c in re.sub(r"\d[eE][-+]?\d", "", text.text.split("\n", 1)[0])):
            found = read_matrix(spark, name).select("x", "y", "q")
        else:
            q, _ = from_paml_text(text.text, states)
            found = spark.createDataFrame([(a, b, q[i][j]) for i, a in enumerate(states) for j, b in enumerate(states)], "x string, y string, q double")
    return found if rate is None else R.normalized(found, rate)


def _text_names(msa: DataFrame) -> DataFrame:
    return msa.withColumn("seq_name", F.col("seq_name").cast("string"))


def _initial(spark: SparkSession, counts: DataFrame, states: list[str], s: Settings, mask: DataFrame | None = None) -> DataFrame:
    if s.initial == "jtt-ipw":
        return R.jtt_ipw(counts, states, s.points, mask=mask)
    if s.initial == "equ":
        return R.equal_rates(spark, states)
    if s.initial == "equ_x_equ":
        letters = sorted({x[0] for x in states}, key=[x[0] for x in states].index)
        one = R.equal_rates(spark, letters)
        return R.chain_product(one, one)
    if "/" in s.initial or s.initial.endswith(".txt"):
        return named_matrix(spark, s.initial, states)
    if s.initial == "random":
        rng = np.random.default_rng(0)
        e, pi = rng.gamma(1, 1, (len(states),) * 2) + 0.1, np.full(len(states), 1 / len(states))
        q = (e + e.T) * pi
        np.fill_diagonal(q, 0)
        q -= np.diag(q.sum(axis=1))
        return spark.createDataFrame([(a, b, float(q[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)], "x string, y string, q double")
    raise ValueError(f"no initial matrix {s.initial}")


def _fitted(counts: DataFrame, start: DataFrame, states: list[str], s: Settings, mask: DataFrame | None) -> DataFrame:
    """The most likely matrix of counts.  No counts at all are an error: they say nothing of any rate."""
    if counts.isEmpty():
        raise ValueError("no transition between the states was counted")
    if s.optimizer == "em":
        return learn_by_expectation(counts, start, states, s.points, mask, s.mode.endswith("reversible"), s.epochs)
    return learn_from_counts(counts, start, states, s.points, mask=mask, epochs=s.epochs, rate=s.rate, mode=s.mode, optimizer=s.optimizer)


def learn_rate_matrix_by_em(msa: DataFrame, states: list[str], settings: Settings | None = None, **how) -> DataFrame:
    """learn_rate_matrix() by expectation and maximisation from the counts of cherries."""
    s = replace(settings or Settings(epochs=500), strategy="cherry", optimizer="em")
    return learn_rate_matrix(msa, states, s, **how)


def chosen(rows: DataFrame, families: list[str] | None) -> DataFrame:
    """The rows of some families."""
    return rows if families is None else rows.where(F.col("family").cast("string").isin(families))


def learn_rate_matrix(msa: DataFrame, states: list[str], settings: Settings | None = None, sites: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(x, y, q): trees and site rates, quantized counts, closed-form start, maximum likelihood; again with the new
    matrix as often as asked.  Only counts, of points x states x states rows at most, reach the driver.

    sites: (family, k, site), the sites that are counted; trees come from all.  mask: (x, y, m), 0 for changes that are
    not allowed.
    """
    s, spark = settings or Settings(), msa.sparkSession
    msa = chosen(msa, s.families)
    estimate = estimator(s)
    q = _equal(len(states)) if s.first is None else s.first
    learned = R.equal_rates(spark, states)
    for _ in range(s.iterations):
        edges, rates = estimate(msa, states, normalized(q))
        edges, rates = chosen(edges, s.families), chosen(rates, s.families)
        own = _text_names(msa) if edges.schema["child"].dataType.simpleString() == "string" else msa
        if sites is not None:
            own, rates = site_subset(own, sites), site_subset_rates(rates, sites)
        found = C.count_transitions(pairs(edges, s.strategy), own, s.points, states, s.strategy, rates).persist()
        learned = _fitted(found, _initial(spark, found, states, s, mask), states, s, mask)
        found.unpersist()
        q = dense(learned, states)[1]
    return learned


def one_change_mask(spark: SparkSession, states: list[str]) -> DataFrame:
    """(x, y, m) over pairs of states: 1 where at most one of the two differs."""
    both = [a + b for a in states for b in states]
    return spark.createDataFrame([(x, y, int(sum(p != r for p, r in zip(x, y, strict=True)) < 2)) for x in both for y in both], "x string, y string, m int")


def learn_coevolution(msa: DataFrame, contacts: DataFrame, states: list[str], settings: Settings | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(x, y, q) over pairs of states at sites in contact; contacts are (family, i, j), of which a matching is used.

    mask: (x, y, m) over pairs of states; where it is not given, one of the two changes at a time.
    """
    s, spark = settings or Settings(epochs=20), msa.sparkSession
    msa, contacts = chosen(msa, s.families), chosen(contacts, s.families)
    estimate = estimator(s)
    edges, _ = estimate(msa, states, normalized(_equal(len(states))))
    own = _text_names(msa) if edges.schema["child"].dataType.simpleString() == "string" else msa
    edges = chosen(edges, s.families)
    match = K.maximal_matching(contacts, s.distance) if s.matching else K.nontrivial(contacts, s.distance)
    both = [a + b for a in states for b in states]
    found = C.count_co_transitions(pairs(edges, s.strategy), own, match, s.points, states, s.strategy, s.distance).persist()
    mask = one_change_mask(spark, states) if mask is None else mask
    learned = _fitted(found, _initial(spark, found, both, s, mask), both, s, mask)
    found.unpersist()
    return learned


def learn_site_specific(msa: DataFrame, states: list[str], q: np.ndarray, edges: DataFrame | None = None, points: list[float] | None = None, strength: float = 0.5, epochs: int = 100, strategy: str = "cherry++", rates: DataFrame | None = None) -> DataFrame:
    """(family, site, x, y, q): a matrix for every site, drawn towards q times the site's rate.

    Without edges, trees come from the alignment, and site rates with them.  Strategy edge counts along all branches,
    inner nodes having their most parsimonious sequences.  rates: (family, site, rate), estimated where not given.
    """
    points = grid() if points is None else points
    if edges is None:
        edges, rates = fast_cherries(msa, states, q, points)
        msa = _text_names(msa)
        rates = rates.select("family", F.posexplode("rates").alias("site", "rate"))
    found = pairs(edges, strategy)
    if strategy == "edge":
        node = edges.schema["parent"].dataType.simpleString()
        inner = ancestral_states(edges, msa, states).select("family", F.col("node").cast(node).alias("seq_name"), "seq")
        msa = inner.persist()  # both ends of each branch are looked up in it
    if rates is None:
        rates = estimate_site_rates(C.site_transitions(C.sequence_pairs(found, msa)), states, q, points)
        every = msa.groupBy("family").agg(F.max(F.length("seq")).alias("w")).select("family", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("site"))
        rates = every.join(rates, ["family", "site"], "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    return learn_site_models(found, msa, rates, states, q, points, strength, epochs, strategy)


def held_out_site_likelihood(train: DataFrame, edges: DataFrame, test: DataFrame, states: list[str], q: np.ndarray, gap: str | None = None, **how) -> DataFrame:
    """(family, tid, ll, lls, ll_base): transitions (family, tid, x_seq, y_seq, t) under site models learned from train,
    and under q alone."""
    models = learn_site_specific(train, states, q, edges, **how)
    base = models.select("family", "site").distinct().crossJoin(F.broadcast(_long(train.sparkSession, states, q)))  # states x states entries a site
    own = by_transition(site_model_likelihood(test, models, states, gap))
    other = by_transition(site_model_likelihood(test, base, states, gap)).select("family", "tid", F.col("ll").alias("ll_base"))
    return own.join(other, ["family", "tid"])


def _long(spark: SparkSession, states: list[str], q: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(a, b, float(q[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)], "x string, y string, q double")


def evaluate(edges: DataFrame, msa: DataFrame, states: list[str], q: np.ndarray, rates: DataFrame | None = None) -> DataFrame:
    """(family, ll, n_sites, ll_per_site) of a matrix on trees and their alignments."""
    return by_family(tree_likelihood(edges, msa, states, q, rates=rates))


def by_family(ll: DataFrame) -> DataFrame:
    """(family, ll, n_sites, ll_per_site) of (family, site, ll)."""
    return ll.groupBy("family").agg(F.sum("ll").alias("ll"), F.count("*").alias("n_sites")).withColumn("ll_per_site", F.col("ll") / F.col("n_sites"))


def evaluate_pairs(edges: DataFrame, msa: DataFrame, contacts: DataFrame, states: list[str], q: np.ndarray, pair_q: np.ndarray, distance: int = 7) -> DataFrame:
    """(family, ll, n_sites, ll_per_site): pairs of sites of a matching of the contacts under pair_q, over pairs of
    states, and all other sites under q."""
    both = [a + b for a in states for b in states]
    match = K.maximal_matching(contacts, distance).persist()
    paired = pair_likelihood(edges, msa, match, both, pair_q).select("family", "ll", F.lit(2).alias("sites"))
    ends = match.select("family", F.col("i").alias("site")).union(match.select("family", F.col("j").alias("site")))
    single = tree_likelihood(edges, msa, states, q).join(ends, ["family", "site"], "left_anti").select("family", "ll", F.lit(1).alias("sites"))
    by = paired.union(single).groupBy("family").agg(F.sum("ll").alias("ll"), F.sum("sites").alias("n_sites"))
    return by.withColumn("ll_per_site", F.col("ll") / F.col("n_sites"))


def compare_models(results: dict[str, DataFrame], base: str) -> DataFrame:
    """(family, model, ll, n_sites, gain, gain_per_site): evaluate()'s results by model, families that all models have,
    and what each gains over the base model."""
    first = results[base].select("family", F.col("ll").alias("ll_base"), "n_sites")
    joined = first
    for name, rows in results.items():
        if name != base:
            joined = joined.join(rows.select("family", F.col("ll").alias(f"ll_{name}")), "family")
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.col("ll_base" if n == base else f"ll_{n}").alias("ll")) for n in results])
    out = joined.select("family", "n_sites", "ll_base", F.explode(models).alias("m")).select("family", "m.model", "m.ll", "n_sites", (F.col("m.ll") - F.col("ll_base")).alias("gain"))
    return out.withColumn("gain_per_site", F.col("gain") / F.col("n_sites"))


def information_gain(compared: DataFrame, model: str, parameters: int, base_parameters: int, resamples: int = 100) -> DataFrame:
    """(resample, gain): how much smaller Akaike's criterion of a model is than that of the base model, over bootstrap
    resamples of compare_models()'s families."""
    own = compared.where(F.col("model") == model).select("family", "gain")
    return R.bootstrap_sums(own, "gain", resamples).select("resample", (2 * F.col("gain") - 2 * (parameters - base_parameters)).alias("gain"))


def independent_pairs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sites without co-evolution: their joint matrix and stationary distribution."""
    pi = stationary_distribution(q)
    return chain_product(q, q), np.kron(pi, pi)
