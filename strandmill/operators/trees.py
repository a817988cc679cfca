"""Trees as edges (family, parent, child, child_ord, length): leaves, traversal and pairs of leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.ranks import with_position
from strandmill.functions.storage import written


def leaves(edges: DataFrame) -> DataFrame:
    """(family, node): children that are no parents."""
    parents = edges.select("family", F.col("parent").alias("child")).distinct()
    return edges.join(parents, ["family", "child"], "left_anti").select("family", F.col("child").alias("node"))


def internal_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("family", F.col("parent").alias("node")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(family, node): parents that are no children."""
    children = edges.select("family", F.col("child").alias("node"))
    return internal_nodes(edges).join(children, ["family", "node"], "left_anti")


def scaled(edges: DataFrame, factor: float = 1.0, prefix: str = "") -> DataFrame:
    """Lengths times a factor, names after a prefix."""
    name = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias(c)
    return edges.select("family", name("parent"), name("child"), "child_ord", (F.col("length") * factor).alias("length"))


def perfect_binary_trees(levels: DataFrame) -> DataFrame:
    """(family, parent, child, child_ord) from (family, levels): nodes 0 to 2 ** levels - 2, the parent of i being (i - 1) div 2.

    Nodes are made in two steps, so that no array is longer than about the root of their number.
    """
    sized = levels.selectExpr("family", "shiftleft(1L, levels) - 1 AS n", "shiftleft(1L, levels div 2) AS low", "shiftleft(1L, levels - levels div 2) AS high")
    starts = sized.select("family", "n", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("k"))
    nodes = starts.select("family", "n", "low", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("low") - 1)).alias("j"))
    own = nodes.select("family", "n", (F.col("k") * F.col("low") + F.col("j")).alias("child")).where("child > 0 and child < n")
    return own.select("family", F.floor((F.col("child") - 1) / 2).cast("long").alias("parent"), "child", ((F.col("child") - 1) % 2).cast("int").alias("child_ord"))


def cherries(edges: DataFrame) -> DataFrame:
    """(family, x, y, t): the two children of nodes that have just two, both leaves."""
    marked = edges.join(leaves(edges).select("family", F.col("node").alias("child"), F.lit(1).alias("leaf")), ["family", "child"], "left")
    by = F.array_sort(F.collect_list(F.struct("child_ord", "child", "length")))
    found = marked.groupBy("family", "parent").agg(F.count("*").alias("n"), F.sum("leaf").alias("leaves"), by.alias("c")).where("n = 2 and leaves = 2")
    return found.select("family", F.col("c")[0]["child"].alias("x"), F.col("c")[1]["child"].alias("y"), (F.col("c")[0]["length"] + F.col("c")[1]["length"]).alias("t"))


def _post_order(children: dict, root) -> Iterator:
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done or node not in children:
            yield node
        else:
            stack.append((node, True))
            stack.extend((c, False) for c, _ in reversed(children[node]))


def children_of(edges: pd.DataFrame) -> tuple[dict, object]:
    """Children and lengths of each node in order, and the root."""
    edges = edges.sort_values(["parent", "child_ord"], kind="stable")
    children: dict = {}
    for p, c, t in zip(edges["parent"], edges["child"], edges["length"], strict=True):
        children.setdefault(p, []).append((c, t))
    top = set(edges["parent"]) - set(edges["child"])
    if len(top) != 1:
        raise ValueError(f"a tree has one root, not {len(top)}")
    return children, top.pop()


def pair_leaves(edges: pd.DataFrame) -> list[tuple]:
    """All leaves but one at most in pairs (x, y, distance): at each node, unmatched leaves pair up in child order."""
    children, root = children_of(edges)
    loose: dict = {}
    pairs = []
    for node in _post_order(children, root):
        if node not in children:
            loose[node] = (node, 0.0)
            continue
        up = [(leaf, d + t) for c, t in children[node] if (found := loose.pop(c)) is not None for leaf, d in [found]]
        pairs += [(a, b, s + t) for (a, s), (b, t) in zip(up[::2], up[1::2], strict=False)]
        loose[node] = up[-1] if len(up) % 2 else None
    return pairs


#: Edges of a family that go through Python as one group; larger trees are paired in rounds.
WHOLE_EDGES = 1 << 17


def families_by_size(rows: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of families of up to `whole` rows, and those of larger ones, None where there are none."""
    large = rows.groupBy("family").count().where(F.col("count") > whole).select("family")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "family", "left_anti"), rows.join(large, "family", "left_semi")


def leaf_pairs(edges: DataFrame, whole: int = WHOLE_EDGES) -> DataFrame:
    """(family, x, y, t): pair_leaves() of each family; of families of over `whole` edges leaf_pairs_in_rounds()."""
    kind = edges.schema["child"].dataType.simpleString()
    family = edges.schema["family"].dataType.simpleString()
    small, large = families_by_size(edges, whole)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(pair_leaves(group), columns=["x", "y", "t"])
        out.insert(0, "family", group["family"].iloc[0])
        return out

    found = small.groupBy("family").applyInPandas(run, f"family {family}, x {kind}, y {kind}, t double")
    return found if large is None else found.unionByName(leaf_pairs_in_rounds(large))


def leaf_pairs_in_rounds(edges: DataFrame) -> DataFrame:
    """(family, x, y, t): the pairs of pair_leaves(), of trees of any size.

    A node passes a leaf up if the number of leaves under it is odd, namely that of its last such child.  So leaves are
    counted by contraction, children that pass one up are numbered in order, and the leaves themselves are found by
    doubling steps downwards.
    """
    from strandmill.operators import contraction as T

    ends = leaves(edges).select("family", "node", F.lit(0).alias("block"), F.lit("1").alias("symbols")).dropDuplicates()
    blocks = edges.select("family").distinct().withColumn("block", F.lit(0))
    counter, plan = T.Leaves(), T.contract(edges)
    tables = T.up(plan, edges, ends, None, blocks, counter, keep=True)
    counted = T.down(plan, tables, T.finish(plan, tables, edges, ends, None, blocks, counter), edges, counter)

    @F.pandas_udf("boolean")
    def odd(data: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.float64)[0]) % 2 == 1 for x in data], dtype=bool)

    passing = counted.where(odd("data")).select("family", F.col("node").alias("child"))
    loose = edges.select("family", "parent", "child", "child_ord", "length").join(passing, ["family", "child"])
    placed = with_position(loose, "family", "parent", "child_ord", "child")
    of_parent = placed.groupBy("family", "parent").agg(F.min("position").alias("first"), F.count("*").alias("n"), F.max_by(F.struct("child", "length"), "position").alias("last"))
    of_parent = written(of_parent, "parents")
    # from each node that passes a leaf up, the step down to it
    open_ = of_parent.where("n % 2 = 1").select("family", F.col("parent").alias("node"), F.col("last.child").alias("to"), F.col("last.length").alias("d"), F.lit(False).alias("end"))
    there = ends.select("family", "node", F.col("node").alias("to"), F.lit(0.0).alias("d"), F.lit(True).alias("end"))
    while not open_.isEmpty():  # steps double
        every = there.unionByName(open_).select("family", F.col("node").alias("to"), F.col("to").alias("far"), F.col("d").alias("more"), F.col("end").alias("ended"))
        moved = open_.join(every, ["family", "to"]).select("family", "node", F.col("far").alias("to"), (F.col("d") + F.col("more")).alias("d"), F.col("ended").alias("end"))
        moved = written(moved, "steps")
        there, open_ = there.unionByName(moved.where("end")), moved.where("not end")
    sent = placed.join(there.select("family", F.col("node").alias("child"), F.col("to").alias("leaf"), "d"), ["family", "child"]).join(of_parent.select("family", "parent", "first"), ["family", "parent"])
    rank = F.col("position") - F.col("first")
    both = sent.groupBy("family", "parent", F.floor(rank / 2).alias("pair")).agg(F.array_sort(F.collect_list(F.struct("position", "leaf", (F.col("d") + F.col("length")).alias("d")))).alias("p")).where(F.size("p") == 2)
    return both.select("family", F.col("p")[0]["leaf"].alias("x"), F.col("p")[1]["leaf"].alias("y"), (F.col("p")[0]["d"] + F.col("p")[1]["d"]).alias("t"))


def pairs(edges: DataFrame, strategy: str) -> DataFrame:
    """(family, x, y, t) by strategy: edge, cherry, or any that starts with cherry++."""
    if strategy == "edge":
        return edges.select("family", F.col("parent").alias("x"), F.col("child").alias("y"), F.col("length").alias("t"))
    if strategy == "cherry":
        return cherries(edges)
    if strategy.startswith("cherry++"):
        return leaf_pairs(edges)
    raise ValueError(f"no strategy {strategy}")
