"""Recursions over trees of any size and shape, in rounds over all families at once.

A tree is contracted: each round takes off all leaves, and of the nodes whose only child is no leaf some that are no
neighbours of each other, joining the branches on either side of them into one.  So a round takes at least a
constant share of the nodes off bushy trees and chains alike, and the number of rounds grows with the logarithm of a
tree's size.  `contract()` makes the schedule once, from names alone.  What is computed then follows it in blocks of sites:
`up()` sends a vector over states for each block from nodes taken off to the nodes that they hung on, and a matrix for
each pair of branches that became one; `down()` goes back through the rounds, so that every node gets the vector of
all that hangs under it.  What is left of a family, `whole` edges at most, is one group for each block.

The recursion is given by how a branch changes a vector: sums of products of probabilities (`Likelihood`), or least
costs (`Changes`).  Vectors add over the children of a node; they are logarithms, or costs.  Messages to one node
are added up within each batch before they move, so a node may have any number of children.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.markov import Reversible, expm
from strandmill.functions.storage import written

#: Edges of a family that are left to one group.
WHOLE = 4096
#: Numbers of a vector: sites of a block times states; and of matrices that are made at once.
VECTOR, AT_ONCE = 256, 1 << 22
#: The round of nodes that are never taken off.
NEVER = 1 << 20
#: Least probability whose logarithm is taken.
LEAST = 1e-300


class Recursion:
    """How vectors of a block's sites pass along branches."""

    def __init__(self, states: list[str]):
        self.states = states
        self.sites = max(1, VECTOR // len(states))

    def observed(self, symbols: list[str | None], sep: str) -> np.ndarray:
        """(rows, sites, states) from symbols of a block's sites; what is unknown and what is missing says nothing."""
        out = np.zeros((len(symbols), self.sites, len(self.states)))
        seen: dict[str, np.ndarray] = {}
        for row, text in enumerate(symbols):
            for site, c in enumerate(text.split(sep) if sep and text else text or ()):
                if c not in seen:
                    seen[c] = self.allowed(c)
                out[row, site] = seen[c]
        return out

    def allowed(self, symbol: str) -> np.ndarray:
        raise NotImplementedError

    def branches(self, lengths: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """(branches, sites, states, states), or 1 for sites where they are alike."""
        raise NotImplementedError

    def along(self, matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def joined(self, above: np.ndarray, vector: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The matrix of two branches in a row, with the vector of the node between."""
        raise NotImplementedError


def _safe_log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, LEAST))


class Likelihood(Recursion):
    """Logarithms of the probability of what hangs under a node, by its state."""

    def __init__(self, states: list[str], q: np.ndarray, pi: np.ndarray | None, allowed):
        super().__init__(states)
        self.q, self._allowed = q, allowed
        try:
            self.chain = Reversible(q, pi)
        except (ValueError, FloatingPointError, np.linalg.LinAlgError):
            self.chain = None

    def allowed(self, symbol: str) -> np.ndarray:
        return _safe_log(self._allowed(symbol))

    def branches(self, lengths: np.ndarray, rates: np.ndarray) -> np.ndarray:
        times, place = np.unique(lengths[:, None] * rates, return_inverse=True)
        p = self.chain.expm(times) if self.chain else np.stack([expm(self.q * t) for t in times])
        return _safe_log(p)[place.reshape(len(lengths), -1)]

    def along(self, matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        most = vector.max(axis=-1, keepdims=True)
        shift = matrix.max(axis=(-2, -1), keepdims=True)
        return _safe_log(np.einsum("nbxy,nby->nbx", np.exp(matrix - shift), np.exp(vector - most))) + most + shift[..., 0]

    def joined(self, above: np.ndarray, vector: np.ndarray, below: np.ndarray) -> np.ndarray:
        below = below + vector[..., None]
        a, b = above.max(axis=(-2, -1), keepdims=True), below.max(axis=(-2, -1), keepdims=True)
        return _safe_log(np.exp(above - a) @ np.exp(below - b)) + a + b


class Changes(Recursion):
    """Least numbers of changes under a node, by its state."""

    def allowed(self, symbol: str) -> np.ndarray:
        free = np.zeros(len(self.states))
        if symbol in self.states:
            free += 1e9
            free[self.states.index(symbol)] = 0
        return free

    def branches(self, lengths: np.ndarray, rates: np.ndarray) -> np.ndarray:
        return np.broadcast_to(1.0 - np.eye(len(self.states)), (len(lengths), 1, len(self.states), len(self.states)))

    def along(self, matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        return (matrix + vector[..., None, :]).min(axis=-1)

    def joined(self, above: np.ndarray, vector: np.ndarray, below: np.ndarray) -> np.ndarray:
        below = below + vector[..., None]
        return np.minimum.reduce([above[..., :, k, None] + below[..., None, k, :] for k in range(len(self.states))])


class Leaves(Recursion):
    """The number of leaves under a node."""

    def __init__(self) -> None:
        super().__init__(["leaf"])
        self.sites = 1

    def allowed(self, symbol: str) -> np.ndarray:
        return np.ones(1)

    def branches(self, lengths: np.ndarray, rates: np.ndarray) -> np.ndarray:
        return np.zeros((len(lengths), 1, 1, 1))

    def along(self, matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        return matrix[..., 0] + vector

    def joined(self, above: np.ndarray, vector: np.ndarray, below: np.ndarray) -> np.ndarray:
        return above + vector[..., None] + below


@dataclass
class Schedule:
    """events: (family, node, round, into, below, into_due, ...) of the nodes taken off; left: (family, parent, child) of what stays."""

    events: DataFrame
    left: DataFrame
    #: Even rounds take leaves off, odd ones join branches.
    rounds: list[int]


def contract(edges: DataFrame, whole: int = WHOLE) -> Schedule:
    """The order in which nodes of the trees are taken off.  A family whose edges contain a cycle is an error."""
    now = written(edges.select("family", "parent", "child"), "edges")
    events: list[DataFrame] = []
    size, before = _size(now), -1
    while size[1] > whole:
        if size[0] == before:
            raise ValueError("edges of a family form a cycle")
        before, k = size[0], 2 * len(events)
        inner = now.select("family", F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
        marked = now.join(inner, ["family", "child"], "left")
        rest = marked.where("inner").drop("inner")
        only = rest.groupBy("family", "parent").agg(F.count("*").alias("n"), F.min("child").alias("below"))
        only = only.where("n = 1").select("family", F.col("parent").alias("child"), "below")
        coin = lambda c: F.xxhash64("family", c, F.lit(k))
        least = (coin("child") < coin("parent")) & (coin("child") < coin("below"))
        rest = rest.join(only, ["family", "child"], "left").withColumn("off", F.col("below").isNotNull() & least)
        rest = written(rest, "rest")
        off = rest.where("off")
        taken = marked.where("inner is null").select("family", F.col("child").alias("node"), F.lit(k).alias("round"), F.col("parent").alias("into"), F.lit(None).cast(now.schema["child"].dataType).alias("below"))
        events.append(written(taken.unionByName(off.select("family", F.col("child").alias("node"), F.lit(k + 1).alias("round"), F.col("parent").alias("into"), "below")), "taken"))
        moved = off.select("family", F.col("below").alias("child"), F.col("parent").alias("above"))
        left = rest.where("not off").select("family", "parent", "child").join(moved, ["family", "child"], "left")
        now = written(left.select("family", F.coalesce("above", "parent").alias("parent"), "child"), "edges")
        size = _size(now)
    every = events[0] if events else now.select("family", F.col("child").alias("node"), F.lit(0).alias("round"), F.col("parent").alias("into"), F.col("child").alias("below")).limit(0)
    for e in events[1:]:
        every = every.unionByName(e)
    rounds = sorted(r["round"] for r in every.select("round").distinct().collect())  # a row a round
    return Schedule(_routed(every), now, rounds)


def _size(edges: DataFrame) -> tuple[int, int]:
    """Edges in all, and of the largest family."""
    n = edges.groupBy("family").count().agg(F.sum("count"), F.max("count")).first()
    return n[0] or 0, n[1] or 0


def _routed(events: DataFrame) -> DataFrame:
    """Adds, to each event, where what it makes is used: into_due, the round of the node that it hangs on; and for a joined
    branch the node that uses it (user), its round (user_due) and whether as the branch below it."""
    at = events.select("family", F.col("node").alias("into"), F.col("round").alias("into_due"), F.col("below").alias("into_below"))
    own = events.select("family", F.col("node").alias("below"), F.col("round").alias("below_due"))
    out = events.join(at, ["family", "into"], "left").join(own, ["family", "below"], "left")
    for_above = F.coalesce(F.col("into_below") == F.col("below"), F.lit(False))
    out = out.withColumns({"into_due": F.coalesce("into_due", F.lit(NEVER)), "below_due": F.coalesce("below_due", F.lit(NEVER))})
    out = out.withColumns({"user": F.when(for_above, F.col("into")).otherwise(F.col("below")), "user_due": F.when(for_above, F.col("into_due")).otherwise(F.col("below_due")), "as_below": for_above})
    return written(out.drop("into_below", "below_due"), "events", "round")


def _lengths(schedule: Schedule, edges: DataFrame) -> DataFrame:
    """The events with the lengths of the given branches that they use: length, of the one above, and below_length; null
    where that has become another one."""
    up = edges.select("family", F.col("child").alias("node"), F.col("parent").alias("into"), "length")
    down = edges.select("family", F.col("child").alias("below"), F.col("parent").alias("node"), F.col("length").alias("below_length"))
    return schedule.events.join(up, ["family", "node", "into"], "left").join(down, ["family", "node", "below"], "left")


def _kinds(edges: DataFrame) -> tuple[str, str]:
    return edges.schema["family"].dataType.simpleString(), edges.schema["child"].dataType.simpleString()


#: A row for each node and block, and for each message to it: `e` the node's event, `b` and `u` the branch below and above it,
#: `v` a vector; a node's own vector (`w`) and branch below (`m`) are kept for down().
_EVENT = "into {node}, into_due int, user {node}, user_due int, as_below boolean, below {node}, length double, below_length double, rates binary, symbols string"
_MESSAGE = "family {family}, node {node}, block int, role string, data binary, due int"


def up(schedule: Schedule, edges: DataFrame, symbols: DataFrame, rates: DataFrame | None, blocks: DataFrame, recursion: Recursion, sep: str = "", keep: bool = False) -> dict[int, DataFrame]:
    """Messages by round, of which those due NEVER are for what is left.

    symbols: (family, node, block, symbols); rates: (family, block, rates), binary numbers of a block's sites; blocks:
    (family, block).  keep: the nodes' own vectors and branches stay in the tables as well, for down().
    """
    family, node = _kinds(edges)
    message, kind = _MESSAGE.format(family=family, node=node), _EVENT.format(node=node)
    spark = edges.sparkSession
    events = _lengths(schedule, edges).join(blocks, "family").join(symbols, ["family", "node", "block"], "left")
    events = events.join(rates, ["family", "block"], "left") if rates is not None else events.withColumn("rates", F.lit(None).cast("binary"))
    columns = [x.strip().split(" ")[0] for x in kind.split(",")]
    items = events.select("round", "family", "node", "block", F.lit("e").alias("role"), F.lit(None).cast("binary").alias("data"), *columns)
    items = written(items, "items", "round")
    tables: dict[int, DataFrame] = {}
    for k in schedule.rounds:
        now = items.where(F.col("round") == k).drop("round")
        for t in tables.values():
            came = t.where((F.col("due") == k) & F.col("role").isin("b", "u", "v")).drop("due")
            now = now.unionByName(came, allowMissingColumns=True)
        keys = ["family", "node", "block"]
        dealt = now.repartition(*keys).sortWithinPartitions(*keys, F.col("role") != "e")
        done = dealt.mapInArrow(_round(recursion, sep, keep, pa.schema(_arrow(message, spark))), message)
        tables[k] = written(done, "messages", "due")
    return tables


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _numbers(data: list[bytes], *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), *shape)


def _round(recursion: Recursion, sep: str, keep: bool, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = np.flatnonzero(held.column("role").to_numpy(zero_copy_only=False) == "e")[-1]
            if last:  # the last node's messages may go on
                yield from _taken(held.slice(0, last), recursion, sep, keep, schema)
                held = held.slice(last)
        if held is not None and len(held):
            yield from _taken(held, recursion, sep, keep, schema)

    return run


def _matrices(recursion: Recursion, own: np.ndarray, lengths: np.ndarray, rates: np.ndarray, made: dict[int, bytes]) -> np.ndarray:
    """The branches of rows `own`: the joined ones where there are any, else those of the given lengths."""
    n, s = recursion.sites, len(recursion.states)
    plain = recursion.branches(np.nan_to_num(lengths[own]), rates[own])
    if not made:
        return plain
    out = np.broadcast_to(plain, (len(own), n, s, s)).copy()
    for k, row in enumerate(own.tolist()):
        if row in made:
            out[k] = np.frombuffer(made[row], np.float64).reshape(n, s, s)
    return out


def _taken(table: pa.Table, recursion: Recursion, sep: str, keep: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n, s = recursion.sites, len(recursion.states)
    role = table.column("role").to_numpy(zero_copy_only=False)
    owner = np.cumsum(role == "e") - 1
    data = table.column("data")
    # names of nodes may be missing, and are no floating-point numbers then
    events = table.filter(pa.array(role == "e")).drop_columns(["role", "data"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    vectors = recursion.observed(events["symbols"].tolist(), sep)
    at = np.flatnonzero(role == "v")
    if len(at):
        np.add.at(vectors, owner[at], _numbers(data.take(pa.array(at)).to_pylist(), n, s))
    above, below = ({int(owner[i]): data[int(i)].as_py() for i in np.flatnonzero(role == r)} for r in "ub")
    rates = np.ones((len(events), 1))
    if events["rates"].notna().any():
        rates = _numbers(events["rates"].tolist(), n)
    lengths, below_lengths = (events[c].to_numpy(float) for c in ("length", "below_length"))
    joins = events["below"].notna().to_numpy()

    out: list[pd.DataFrame] = []

    def rows(own: np.ndarray, name: str, block: str, role_: str, values: np.ndarray | list, due) -> None:
        content = [v.tobytes() for v in values] if isinstance(values, np.ndarray) else values
        frame = pd.DataFrame({"family": events["family"].iloc[own].to_numpy(), "node": events[name].iloc[own].to_numpy(), "block": events[block].iloc[own].to_numpy(), "role": role_, "data": content})
        out.append(frame.assign(due=due))

    step = max(1, AT_ONCE // (n * s * s))
    for own in np.array_split(np.flatnonzero(~joins), -(-int((~joins).sum()) // step) or 1):
        if not len(own):
            continue
        sent = recursion.along(_matrices(recursion, own, lengths, rates, above), vectors[own])
        to = events.iloc[own].groupby(["family", "into", "block"], sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(to, return_index=True)[1]
        sums = np.zeros((len(first), n, s))
        np.add.at(sums, to, sent)
        rows(own[first], "into", "block", "v", sums, events["into_due"].to_numpy()[own[first]])
    for own in np.array_split(np.flatnonzero(joins), -(-int(joins.sum()) // step) or 1):
        if not len(own):
            continue
        under = _matrices(recursion, own, below_lengths, rates, below)
        both = recursion.joined(_matrices(recursion, own, lengths, rates, above), vectors[own], under)
        both = np.ascontiguousarray(np.broadcast_to(both, (len(own), n, s, s)))
        user, as_below = events["user_due"].to_numpy()[own], events["as_below"].to_numpy(bool)[own]
        for flag, name in ((True, "b"), (False, "u")):
            pick = np.flatnonzero(as_below == flag)
            if len(pick):
                rows(own[pick], "user", "block", name, both[pick], user[pick])
        if keep:
            under = np.ascontiguousarray(np.broadcast_to(under, (len(own), n, s, s)))
            rows(own, "node", "block", "m", under, -1)
    if keep:
        rows(np.arange(len(events)), "node", "block", "w", vectors, -1)
    if out:
        yield pa.RecordBatch.from_pandas(pd.concat(out), schema, preserve_index=False)


def finish(schedule: Schedule, tables: dict[int, DataFrame], edges: DataFrame, symbols: DataFrame, rates: DataFrame | None, blocks: DataFrame, recursion: Recursion, sep: str = "") -> DataFrame:
    """(family, node, block, top, data): vectors of all nodes that were left; top marks the root.  A family that does not
    have just one root is an error."""
    family, node = _kinds(edges)
    lengths = edges.select("family", "parent", "child", "length")
    given = schedule.left.join(lengths, ["family", "parent", "child"], "left").join(blocks, "family")
    off = schedule.events.select("family", "node")
    none = lambda kind: F.lit(None).cast(kind)
    kind = {"role": "string", "parent": node, "length": "double", "rates": "binary", "symbols": "string", "data": "binary"}
    shaped = lambda df: df.select("family", "block", "node", *[c if c in df.columns else none(t).alias(c) for c, t in kind.items()])
    branches = given.withColumnRenamed("child", "node").withColumn("role", F.lit("e"))
    if rates is not None:
        branches = branches.join(rates, ["family", "block"])
    rows = shaped(branches).unionByName(shaped(symbols.join(off, ["family", "node"], "left_anti").withColumn("role", F.lit("s"))))
    for t in tables.values():
        rows = rows.unionByName(shaped(t.where((F.col("due") == NEVER) & F.col("role").isin("b", "u", "v")).drop("due")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name, block = group["family"].iloc[0], int(group["block"].iloc[0])
        n, s = recursion.sites, len(recursion.states)
        tree = group[group["role"] == "e"]
        numbers = pd.Index(pd.concat([group["node"], tree["parent"]]).unique())
        vectors = np.zeros((len(numbers), n, s))
        seen = group[group["role"] == "s"]
        np.add.at(vectors, numbers.get_indexer(seen["node"]), recursion.observed(seen["symbols"].tolist(), sep))
        sent = group[group["role"] == "v"]
        if len(sent):
            np.add.at(vectors, numbers.get_indexer(sent["node"]), _numbers(sent["data"].tolist(), n, s))
        made = dict(zip(numbers.get_indexer(group.loc[group["role"] == "u", "node"]).tolist(), group.loc[group["role"] == "u", "data"], strict=True))
        child, parent = numbers.get_indexer(tree["node"]), numbers.get_indexer(tree["parent"])
        waits, above = np.bincount(parent, minlength=len(numbers)), np.full(len(numbers), -1)
        above[child] = np.arange(len(child))
        if len(top := np.flatnonzero(above < 0)) != 1:
            raise ValueError(f"a tree has one root, not {len(top)}")
        rate = _numbers(tree["rates"].tolist(), n) if len(tree) and tree["rates"].notna().any() else np.ones((len(tree), 1))
        length = tree["length"].to_numpy(float)
        ready = np.flatnonzero((waits == 0) & (above >= 0))
        step = max(1, AT_ONCE // (n * s * s))
        while len(ready):  # a level at a time, in parts
            for own in np.array_split(ready, -(-len(ready) // step)):
                rows_ = above[own]
                matrix = recursion.branches(np.nan_to_num(length[rows_]), rate[rows_])
                if any(k in made for k in own.tolist()):
                    matrix = np.broadcast_to(matrix, (len(own), n, s, s)).copy()
                    for k, v in enumerate(own.tolist()):
                        if v in made:
                            matrix[k] = np.frombuffer(made[v], np.float64).reshape(n, s, s)
                np.add.at(vectors, parent[rows_], recursion.along(matrix, vectors[own]))
            np.subtract.at(waits, parent[above[ready]], 1)
            up_ = np.unique(parent[above[ready]])
            ready = up_[(waits[up_] == 0) & (above[up_] >= 0)]
        return pd.DataFrame({"family": name, "node": numbers, "block": block, "top": above < 0, "data": [v.tobytes() for v in vectors]})

    return rows.groupBy("family", "block").applyInPandas(run, f"family {family}, node {node}, block int, top boolean, data binary")


def down(schedule: Schedule, tables: dict[int, DataFrame], left: DataFrame, edges: DataFrame, recursion: Recursion) -> DataFrame:
    """(family, node, block, data): the vectors of all nodes, from up()'s tables with keep and finish()'s rows."""
    known = left.select("family", "node", "block", "data")
    off = schedule.events.select("family", "node", "below", "round")
    for k, t in tables.items():
        if k % 2 == 0:
            known = known.unionByName(t.where("role = 'w'").select("family", "node", "block", "data"))
    known = written(known, "vectors")

    @F.pandas_udf("binary")
    def whole(vector: pd.Series, matrix: pd.Series, under: pd.Series) -> pd.Series:
        n, s = recursion.sites, len(recursion.states)
        step = max(1, AT_ONCE // (n * s * s))
        out: list[bytes] = []
        for k in range(0, len(vector), step):
            v, m, u = (x.iloc[k : k + step].tolist() for x in (vector, matrix, under))
            sums = _numbers(v, n, s) + recursion.along(_numbers(m, n, s, s), _numbers(u, n, s))
            out += [x.tobytes() for x in sums]
        return pd.Series(out)

    for k in sorted((k for k in schedule.rounds if k % 2), reverse=True):
        events = off.where(F.col("round") == k).drop("round")
        own = lambda role, name: tables[k].where(F.col("role") == role).select("family", "node", "block", F.col("data").alias(name))  # noqa: B023, E731
        rows = events.join(own("w", "vector"), ["family", "node"]).join(own("m", "matrix"), ["family", "node", "block"])
        rows = rows.join(known.select("family", F.col("node").alias("below"), "block", F.col("data").alias("under")), ["family", "below", "block"])
        known = known.unionByName(written(rows.select("family", "node", "block", whole("vector", "matrix", "under").alias("data")), "vectors"))
    return known


def blocks_of(sites: DataFrame, recursion: Recursion) -> DataFrame:
    """(family, block) from (family, n_sites)."""
    last = F.greatest(F.ceil(F.col("n_sites") / recursion.sites).cast("int") - 1, F.lit(0))
    return sites.select("family", F.explode(F.sequence(F.lit(0), last)).alias("block"))


def symbols_of(msa: DataFrame, sites: int, sep: str = "") -> DataFrame:
    """(family, node, block, symbols) from (family, seq_name, seq)."""
    size = F.size(F.split("seq", sep)) if sep else F.length("seq")
    block = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / sites).cast("int") - 1, F.lit(0)))).alias("block")
    rows = msa.where("seq is not null").select("family", F.col("seq_name").alias("node"), "seq", block)
    if sep:
        part: Column = F.array_join(F.slice(F.split("seq", sep), F.col("block") * sites + 1, F.lit(sites)), sep)
    else:
        part = F.substring("seq", F.col("block") * sites + 1, F.lit(sites))
    return rows.select("family", "node", "block", part.alias("symbols"))
