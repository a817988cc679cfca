"""Newick trees to edges and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from strandmill.operators.trees import _post_order, children_of

_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),;]|:\s*[^\s(),;]+|[^\s(),:;']+")


@dataclass
class _Node:
    name: str = ""
    length: float = 0.0
    children: list[_Node] = field(default_factory=list)


def parse(text: str, resolve_root: bool = False) -> list[tuple[str, str, int, float]]:
    """(parent, child, child_ord, length); unnamed nodes are called internal-0, internal-1, ... from the root on.

    resolve_root: a root of three children gets two, by a new node half way along its first branch.
    """
    node, path = _Node(), []
    for token in _TOKEN.findall(re.sub(r"\[[^\]]*\]", "", text)):
        if token == "(":
            path.append(node)
            node = _Node()
            path[-1].children.append(node)
        elif token == ",":
            node = _Node()
            path[-1].children.append(node)
        elif token == ")":
            node = path.pop()
        elif token == ";":
            break
        elif token[0] == ":":
            node.length = float(token[1:])
        else:
            node.name = token.strip("'").replace("''", "'")
    if path:
        raise ValueError("a parenthesis is not closed")
    root = node
    if resolve_root and len(root.children) == 3:
        first, *rest = root.children
        half = first.length / 2
        first.length = half
        root.children = [first, _Node("", half, rest)]
    number, edges = 0, []
    stack = [root]
    while stack:
        at = stack.pop()
        if not at.name:
            at.name, number = f"internal-{number}", number + 1
        stack.extend(reversed(at.children))
        edges.append(at)
    return [(p.name, c.name, k, c.length) for p in edges for k, c in enumerate(p.children)]


def render(edges: pd.DataFrame) -> str:
    children, root = children_of(edges)
    done: dict = {}
    for node in _post_order(children, root):
        inner = ",".join(f"{done.pop(c)}:{t:.10g}" for c, t in children.get(node, ()))
        done[node] = f"({inner}){node}" if inner else str(node)
    return done[root] + ";"


def read_newick(trees: DataFrame, resolve_root: bool = False) -> DataFrame:
    """(family, parent, child, child_ord, length) of rows (family, newick)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for family, text in batch.itertuples(index=False):
                out = pd.DataFrame(parse(text, resolve_root), columns=["parent", "child", "child_ord", "length"])
                out.insert(0, "family", family)
                yield out

    return trees.select("family", "newick").mapInPandas(run, "family string, parent string, child string, child_ord int, length double")


def to_newick(edges: DataFrame) -> DataFrame:
    """(family, newick)."""
    kind = edges.schema["family"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"family": [group["family"].iloc[0]], "newick": [render(group)]})

    return edges.groupBy("family").applyInPandas(run, f"family {kind}, newick string")
