"""python -m strandmill learn|evaluate|sites: matrices from folders of alignments, and their likelihood."""

from __future__ import annotations

import argparse
from pathlib import Path

import numpy as np


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandmill", description=__doc__)
    parser.add_argument("task", choices=["learn", "evaluate", "sites"])
    parser.add_argument("--output", required=True)
    parser.add_argument("--msa", required=True, help="folder of two-line FASTA files, one a family")
    parser.add_argument("--families", nargs="+", help="families that are used; all by default")
    parser.add_argument("--trees", help="folder of trees; without it sequences are paired")
    parser.add_argument("--rates", help="folder of site rates that go with the trees")
    parser.add_argument("--sites", help="folder of sites that are counted; all by default")
    parser.add_argument("--contacts", help="folder of contact maps: learns, or evaluates, a matrix of pairs of states")
    parser.add_argument("--mask", help="matrix of 0 for changes that are not allowed")
    parser.add_argument("--matrix", help="rate matrix to evaluate, or to draw site models towards")
    parser.add_argument("--pair-matrix", help="rate matrix of pairs of states, to evaluate contacts with")
    parser.add_argument("--states", default="ARNDCQEGHILKMFPSTWYV")
    parser.add_argument("--strategy", default="cherry++", choices=["edge", "cherry", "cherry++"])
    parser.add_argument("--tree-estimator", default="fast_cherries")
    parser.add_argument("--tree-matrix", help="rate matrix that trees are first estimated with; equal rates by default")
    parser.add_argument("--categories", type=int, default=20, help="site rates that tree estimation tries")
    parser.add_argument("--initial", default="jtt-ipw", help="jtt-ipw, equ, equ_x_equ, random, or the path of a matrix")
    parser.add_argument("--mode", default="pande_reversible", help="parameterisation of the matrix")
    parser.add_argument("--optimizer", default="adam", choices=["adam", "sgd", "lbfgs", "spectral", "em"])
    parser.add_argument("--learning-rate", type=float, default=0.1)
    parser.add_argument("--iterations", type=int, default=1)
    parser.add_argument("--epochs", type=int, default=500)
    parser.add_argument("--grid-center", type=float, default=0.03)
    parser.add_argument("--grid-step", type=float, default=1.1)
    parser.add_argument("--grid-steps", type=int, default=64)
    parser.add_argument("--distance", type=int, default=7, help="sites that a contact's ends are apart at least")
    parser.add_argument("--all-contacts", action="store_true", help="use all contacts instead of a matching")
    parser.add_argument("--strength", type=float, default=0.5, help="share of pseudocounts in site models")
    parser.add_argument("--cache", help="folder in which results are kept and looked up by what they were made from")
    parser.add_argument("--parallelism", type=int, help="partitions of shuffles; Spark's setting by default")
    own = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from strandmill.functions.grid import grid
    from strandmill.functions.markov import dense
    from strandmill.operators.rates import equal_rates
    from strandmill.plans import pipelines as P
    from strandmill.plans.cache import cached
    from strandmill.sources import formats as S

    spark = SparkSession.builder.getOrCreate()
    if own.parallelism:
        spark.conf.set("spark.sql.shuffle.partitions", own.parallelism)
    states = list(own.states)
    msa = P.chosen(S.read_msa(spark, own.msa), own.families)
    edges = P.chosen(S.read_tree(spark, own.trees), own.families) if own.trees else None
    matrix = lambda path: P.named_matrix(spark, path, [a + b for a in states for b in states] if path == own.pair_matrix else states)
    q: np.ndarray = dense(matrix(own.matrix) if own.matrix else equal_rates(spark, states), states)[1]
    rates = None
    if edges is not None:
        read = S.read_site_rates(spark, own.rates) if own.rates else None
        sites = msa.groupBy("family").agg(F.max(F.length("seq")).alias("w"))
        ones = sites.select("family", F.array_repeat(F.lit(1.0), F.col("w")).alias("rates"))
        rates = ones if read is None else read.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("site", "rate"))), lambda r: r["rate"]).alias("rates"))
    settings = P.Settings(
        strategy=own.strategy,
        points=grid(own.grid_center, own.grid_step, own.grid_steps),
        estimator=P.given_trees(edges, rates) if edges is not None else own.tree_estimator,
        initial=own.initial,
        iterations=own.iterations,
        epochs=own.epochs,
        rate=own.learning_rate,
        distance=own.distance,
        mode=own.mode,
        optimizer=own.optimizer,
        categories=own.categories,
        first=dense(matrix(own.tree_matrix), states)[1] if own.tree_matrix else None,
        families=own.families,
        matching=not own.all_contacts,
    )
    contacts = S.read_contact_map(spark, own.contacts) if own.contacts else None
    mask = S.read_matrix(spark, own.mask, "m").select("x", "y", F.col("m").cast("int").alias("m")) if own.mask else None

    def make():
        if own.task == "learn":
            subset = S.read_sites_subset(spark, own.sites) if own.sites else None
            return P.learn_coevolution(msa, contacts, states, settings, mask) if contacts is not None else P.learn_rate_matrix(msa, states, settings, subset, mask)
        if own.task == "sites":
            return P.learn_site_specific(msa, states, q, edges, settings.points, own.strength, own.epochs, own.strategy)
        tree, site_rates, rows = edges, rates, msa
        if tree is None:
            tree, site_rates = P.estimator(settings)(msa, states, q)
            rows = msa.withColumn("seq_name", F.col("seq_name").cast("string"))
        if contacts is not None:
            both = [a + b for a in states for b in states]
            return P.evaluate_pairs(tree, rows, P.chosen(contacts, own.families), states, q, dense(matrix(own.pair_matrix), both)[1] if own.pair_matrix else P.independent_pairs(q)[0], own.distance)
        return P.evaluate(tree, rows, states, q, site_rates)

    files = [matrix(path) for path in (own.matrix, own.tree_matrix, own.pair_matrix) if path]
    files += [S.read_sites_subset(spark, own.sites)] if own.sites else []
    files += [P.named_matrix(spark, own.initial, states)] if "/" in own.initial or own.initial.endswith(".txt") else []
    # what files hold counts, not only where they are
    inputs = [df for df in (msa, edges, rates, contacts, mask, *files) if df is not None]
    told = {k: v for k, v in vars(own).items() if k not in ("output", "cache")}
    found = cached(spark, own.cache, own.task, make, *inputs, **told) if own.cache else make()
    if own.task == "learn":
        Path(own.output).write_text(S.matrix_text(found).first().text + "\n")
    else:
        found.write.mode("overwrite").parquet(own.output)


if __name__ == "__main__":
    main()
