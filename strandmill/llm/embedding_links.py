"""Near-duplicate embeddings by collision counting over one-dimensional random projections.

Unit vectors are projected on many random lines.  Projections are taken in groups: a table sorts vectors by the cells
of its group's lines, so that vectors close together share the cell in some table with a probability that sets the
number of tables for a wanted recall.  For each pair in a cell, the lines are counted on which one vector lies within
a window centred on the other; pairs with fewer collisions than all but a tiny part of true pairs have are discarded,
and the rest are verified by their cosine in double precision.  A pair that an earlier table brings together as well
is left to that table, so each link is counted once and no pairs leave a task: only counts per vector and
a forest of links do.  Equal vectors are one vector with a weight.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing and are their own
component.  Vectors of different lengths do not link.  Repeated rows are different vectors with equal components.
A vector with a null id has links like any other, and null is never a component's id unless all ids in it are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._bytes import mix
from strandmill.llm._shared import connected_components, joined, paired_blocks, written

COSINE, RECALL = 0.95, 0.998
#: Width of a cell, lines of a table; half width of a window, lines counted, and the part of true pairs that pass.
CELL, LINES = 1.8, 9
WINDOW, COUNTED, PASS = 0.6, 64, 0.9999
BUCKET = 2048
_SMALL = 64


def _gap(cosine: float) -> float:
    """Standard deviation of the difference of two unit vectors' projections."""
    return math.sqrt(2 * (1 - cosine))


def tables_for(cosine: float = COSINE, recall: float = RECALL) -> int:
    """Tables after which a pair of just this cosine has shared a cell with probability recall."""
    one = 1 - math.sqrt(2 / math.pi) * _gap(cosine) / CELL
    return math.ceil(math.log(1 - recall) / math.log(1 - one**LINES))


def collisions_for(cosine: float = COSINE, passing: float = PASS) -> int:
    """The most collisions that a pair of just this cosine reaches with probability passing."""
    p = math.erf(WINDOW / _gap(cosine) / math.sqrt(2))
    tail = 0.0
    for k in range(COUNTED, -1, -1):
        tail += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if tail >= passing:
            return k
    return 0


class _Lines:
    """The random lines for vectors of one length."""

    _made: dict[tuple[int, int], _Lines] = {}

    def __init__(self, dim: int, tables: int):
        rng = np.random.default_rng([dim, 6])
        self.tables = tables
        self.directions = rng.standard_normal((dim, tables * LINES))
        self.offsets = rng.uniform(0, CELL, tables * LINES)
        self.counted = rng.standard_normal((dim, COUNTED))

    @classmethod
    def of(cls, dim: int, tables: int) -> _Lines:
        return cls._made.setdefault((dim, tables), cls(dim, tables)) if (dim, tables) not in cls._made else cls._made[dim, tables]

    @classmethod
    def of_bytes(cls, vecs: pa.Array, kind: str, tables: int) -> np.ndarray:
        """cells() of vectors of one length."""
        units = _units(vecs, kind)
        return cls.of(units.shape[1], tables).cells(units)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """One key per vector and table."""
        cell = np.floor((units @ self.directions + self.offsets) / CELL).astype(np.int64)
        out = np.zeros((len(units), self.tables), np.uint64)
        for k in range(LINES):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cell[:, k::LINES].view(np.uint64))
        return mix(out + np.arange(self.tables, dtype=np.uint64) + np.uint64(units.shape[1]) * np.uint64(1 << 20))


def _units(vecs: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length, each of length 1."""
    v = np.frombuffer(b"".join(vecs.to_pylist()), kind).reshape(len(vecs), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares can neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _valid(embeddings: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, name, vec): vec has the components, or null for a vector that links with nothing; name is a hash of vec."""
    of = embeddings.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind) + 0.0  # null is not a number; -0.0 becomes 0.0
            first = np.cumsum(size) - size
            vecs: list[bytes | None] = [None] * len(size)
            for n in np.unique(size[size > 0]).tolist():
                row = np.flatnonzero(size == n)
                part = values[first[row][:, None] + np.arange(n)]
                for k in np.flatnonzero(np.isfinite(part).all(axis=1) & (part != 0).any(axis=1)).tolist():
                    vecs[row[k]] = part[k].tobytes()
            names = [None if v is None else xxhash.xxh3_128_digest(v) for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(vecs, pa.binary())], ["id", "name", "vec"])

    return embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {of}, name binary, vec binary")


def _by_length(vecs: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of the vectors of each length."""
    size = pc.binary_length(vecs).to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        yield np.flatnonzero(size == n)


def _bring_together(tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _by_length(batch.column(1)):
                for at in range(0, len(row), 512):
                    own = batch.take(pa.array(row[at : at + 512]))
                    keys = _Lines.of_bytes(own.column(1), kind, tables)
                    again = pa.array(np.repeat(np.arange(own.num_rows), tables))
                    number = pa.array(np.tile(np.arange(tables, dtype=np.int32), own.num_rows))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), number, own.column(0).take(again)], ["key", "number", "rep"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A part of the links that connects what all of them connect."""
    parent: dict[int, int] = {}
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = x, y
        while (up := parent.get(p, p)) != p:
            parent[p] = parent.get(up, up)
            p = up
        while (up := parent.get(q, q)) != q:
            parent[q] = parent.get(up, up)
            q = up
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compare(tables: int, cosine: float, kind: str):
    enough = collisions_for(cosine)

    def links(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows i and j of one cell, those that are links and that no earlier table has."""
        found = []
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            count = (np.abs(rows["counted"][a] - rows["counted"][b]) <= WINDOW).sum(axis=1)
            a, b = a[count >= enough], b[count >= enough]
            near = np.einsum("ij,ij->i", rows["units"][a], rows["units"][b]) >= cosine
            a, b = a[near], b[near]
            earlier = ((rows["cells"][a] == rows["cells"][b]) & (np.arange(tables) < rows["number"][a][:, None])).any(axis=1)
            found.append((a[~earlier], b[~earlier]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def whole(rows: dict[str, np.ndarray], first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links in whole buckets, given by their first rows and sizes."""
        out = []
        small = size <= _SMALL
        start = np.repeat(first[small] + size[small], size[small])  # the end of each row's bucket
        row = np.concatenate([np.arange(f, f + n) for f, n in zip(first[small], size[small], strict=True)]) if small.any() else np.zeros(0, np.int64)
        for step in range(1, int(size[small].max(initial=1))):
            row, start = row[row + step < start], start[row + step < start]
            out.append((row, row + step))
        for f, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
            for a in range(f, f + n - 1):
                out.append((np.full(f + n - 1 - a, a), np.arange(a + 1, f + n)))
        found = []
        batch, held = [], 0
        for pair in [*out, None]:
            if pair is not None:
                batch.append(pair)
                held += len(pair[0])
            if batch and (pair is None or held > 1 << 17):
                i, j = (np.concatenate([p[k] for p in batch]) for k in (0, 1))
                meet = (rows["lo"][i] == rows["hi"][i]) | (rows["mine"][i] != rows["mine"][j])
                found.append(links(rows, i[meet], j[meet]))
                batch, held = [], 0
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    names = ["key", "lo", "hi", "mine", "number", "rep", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                table, kept = kept, None
            else:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([kept, table]) if kept is not None else table
            if table is None or not table.num_rows:
                continue
            rows = {n: table.column(n).to_numpy().astype(np.int64) for n in names}
            order = np.stack([rows[n] for n in ("key", "lo", "hi")])
            first = np.concatenate([[0], np.flatnonzero((order[:, 1:] != order[:, :-1]).any(axis=0)) + 1])
            if batch is not None:  # the last bucket may go on
                kept = table.slice(first[-1])
                table, first = table.slice(0, first[-1]), first[:-1]
                rows = {n: v[: table.num_rows] for n, v in rows.items()}
            size = np.diff(np.append(first, table.num_rows))
            use = np.flatnonzero(np.repeat(size > 1, size))
            vecs = table.column("vec").combine_chunks().take(pa.array(use))
            size = np.repeat(size, size)[use]  # of each row's bucket, all of whose vectors have one length
            for part in _by_length(vecs):
                own = {n: v[use[part]] for n, v in rows.items()}
                units = _units(vecs.take(pa.array(part)), kind)
                lines = _Lines.of(units.shape[1], tables)
                own |= {"units": units, "counted": (units @ lines.counted).astype(np.float32), "cells": lines.cells(units)}
                if (found := linked(own, size[part])) is not None:
                    yield found

    def linked(rows: dict[str, np.ndarray], size: np.ndarray) -> pa.RecordBatch | None:
        """Numbers of links and a forest of them, of whole buckets one after the other."""
        first = [0]
        while first[-1] < len(size):
            first.append(first[-1] + int(size[first[-1]]))
        first = np.array(first[:-1])
        i, j = whole(rows, first, size[first])
        if not len(i):
            return None
        rep, weight = rows["rep"], rows["weight"]
        found, at = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([weight[j], weight[i]])).astype(np.int64)
        edges = np.array(_forest(rep[i], rep[j]), np.int64).reshape(-1, 2)
        u = pa.array(np.concatenate([found, edges[:, 0]]))
        v = pa.array(np.concatenate([np.zeros(len(found), np.int64), edges[:, 1]]), mask=np.arange(len(found) + len(edges)) < len(found))
        return pa.RecordBatch.from_arrays([u, v, pa.array(np.concatenate([n, np.zeros(len(edges), np.int64)]))], ["u", "v", "n"])

    return run


def links(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(id, n_links, component): one row per row of embeddings; ids are whole numbers."""
    tables = tables_for(cosine, recall)
    kind = "<f8" if embeddings.schema[vector_col].dataType.elementType.simpleString() == "double" else "<f4"
    rows = written(_valid(embeddings, id_col, vector_col, kind), "vectors")
    distinct = rows.where("name is not null").groupBy("name", "vec").agg(F.min("id").cast("long").alias("least"), F.count("*").alias("weight"))
    # vectors are nodes by a number, as some have no id
    known = written(distinct.select(F.monotonically_increasing_id().alias("rep"), "least", "weight", "name", "vec"), "distinct-vectors")
    # cells hold ids; vectors move only to the cells that several share
    cells = written(known.select("rep", "vec").mapInArrow(_bring_together(tables, kind), "key long, number int, rep long"), "cells")
    shared = written(joined(cells, written(cells.groupBy("key").count().where("count > 1").select("key"), "shared-keys"), "key"), "shared-cells")
    placed = paired_blocks(shared, "key", F.col("rep"), bucket).join(known.select("rep", "weight", "vec"), "rep")
    order = ["key", "lo", "hi"]
    placed = placed.repartition(*order).sortWithinPartitions(*order)
    found = written(placed.mapInArrow(_compare(tables, cosine, kind), "u long, v long, n long"), "links")
    near = found.where("v is null").groupBy("u").agg(F.sum("n").alias("near"))
    nodes = connected_components(found.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b")))
    own = known.select("name", "rep", "least", "weight").join(near, F.col("rep") == F.col("u"), "left").join(nodes, F.col("rep") == F.col("node"), "left")
    own = written(own.select("name", "least", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group")), "nodes")
    own = joined(own, own.groupBy("group").agg(F.min("least").alias("component")), "group").select("name", "n_links", "component")
    out = joined(rows.select("id", "name"), written(own, "labelled-vectors"), "name", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", F.col("id").cast("long")).alias("component"))
