"""Analytics of how discrete states change over time, on Spark DataFrames."""

from strandmill.operators.contacts import backbone_contacts, maximal_matching
from strandmill.operators.counts import count_co_transitions, count_transitions
from strandmill.operators.expectation import learn_by_expectation
from strandmill.operators.fitting import learn_from_counts, learn_sites
from strandmill.operators.rates import jtt_ipw
from strandmill.plans.pipelines import (
    TREE_ESTIMATORS,
    Settings,
    compare_models,
    evaluate,
    evaluate_pairs,
    given_trees,
    held_out_site_likelihood,
    learn_coevolution,
    learn_rate_matrix,
    learn_rate_matrix_by_em,
    learn_site_specific,
    named_matrix,
)

__all__ = [
    "TREE_ESTIMATORS",
    "Settings",
    "backbone_contacts",
    "compare_models",
    "count_co_transitions",
    "count_transitions",
    "evaluate",
    "evaluate_pairs",
    "given_trees",
    "held_out_site_likelihood",
    "jtt_ipw",
    "learn_coevolution",
    "learn_by_expectation",
    "learn_from_counts",
    "learn_rate_matrix",
    "learn_rate_matrix_by_em",
    "learn_site_specific",
    "learn_sites",
    "maximal_matching",
    "named_matrix",
]
