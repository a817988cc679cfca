"""SimHash fingerprints of whole texts and near-duplicate components, found with pivot distance tables.

Two texts link if their fingerprints differ in at most `radius` bits.  The search never compares all fingerprints.  By
the triangle inequality, two fingerprints within `radius` of each other have distances to any reference fingerprint
(pivot) that differ by `radius` at most, and, over a set of bits in which they agree, distances that are equal.  A view
is such a set of bits: its distances to many pivots, as one key, bring together what agrees there.  In a bucket, pairs
are discarded by their largest difference of whole-fingerprint pivot distances, and survivors are verified bit by bit.

For 64 bits and a small radius, the bits are cut into radius + 3 blocks; linked fingerprints agree in three blocks at
least, so views of any three blocks lose no pair.  Texts whose sets of shingles are similar are found by longer
fingerprints and sampled views, and decided by the sets themselves (shingle_sets).

Nulls and empty texts have fingerprint 0, which links like any other.  Rows are never merged: repeated rows give
repeated results.  A null id takes part, but is never a component's id unless all ids in it are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm._bytes import LOWER, chunks, mix, text_array, text_bytes
from strandmill.llm._shared import BROADCAST_ROWS, connected_components, joined, paired_blocks, released, written

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 3
PIVOTS = 16
#: Largest number of fingerprints that one task compares with each other at once.
BUCKET = 4096
#: Buckets up to this size are compared all at once, larger ones one by one.
_SMALL = 64


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, repeats included, of one lower-cased UTF-8 text; the whole text if it has fewer words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, bits: int = BITS) -> bytes:
    """The fingerprint of one lower-cased UTF-8 text, little-endian: a bit is 1 if it is in over half of the hashes.

    Bits beyond the first 64 are those of the hashes mixed with other constants.
    """
    return voted(shingle_hashes(text, shingle), bits)


def voted(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint of hashes."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        part = hashes[at : at + 255]
        wide = np.stack([part if k == 0 else mix(part + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(bits // 64)], axis=1)
        ones += np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(id, fp): one row per row of docs; fp is binary."""
    kind = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            buf, bounds = text_bytes(texts)
            found = []
            for i, j in chunks(bounds):
                lower = LOWER[buf[bounds[i] : bounds[j]]].tobytes()
                at = bounds[i : j + 1] - bounds[i]
                found += [fingerprint(lower[a:b], shingle, bits) for a, b in itertools.pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind.simpleString()}, fp binary")


def exact_views(bits: int = BITS, radius: int = RADIUS) -> list[np.ndarray]:
    """Sets of bits in one of which any two fingerprints within the radius agree."""
    blocks = np.array_split(np.arange(bits), radius + 3)
    return [np.concatenate(chosen) for chosen in itertools.combinations(blocks, 3)]


def as_words(fps: pa.Array) -> np.ndarray:
    """Fingerprints, all of one length, as rows of 64-bit words."""
    n = len(fps)
    if not n:
        return np.zeros((0, 1), np.uint64)
    at = np.frombuffer(fps.buffers()[1], np.int32)[fps.offset : fps.offset + n + 1]
    return np.frombuffer(fps.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u8").reshape(n, -1)


def _pivots(bits: int) -> np.ndarray:
    """Reference fingerprints, as rows of 64-bit words."""
    return np.random.default_rng(64).integers(0, 2**64, (PIVOTS, bits // 64), dtype=np.uint64)


def _distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)


def _place(views: list[np.ndarray], bits: int, checked: int):
    pivots = np.unpackbits(_pivots(bits).view(np.uint8), axis=1, bitorder="little").astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                fps = as_words(batch.column(1))
                own = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                keys = []
                for k, view in enumerate(views):
                    p = pivots[:, view]
                    near = own[:, view].sum(axis=1, keepdims=True) + p.sum(axis=1) - 2 * own[:, view] @ p.T
                    key = np.full(len(fps), k, np.uint64)
                    for d in near.astype(np.uint64).T:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + d)
                    keys.append(key)
                again = pa.array(np.tile(np.arange(len(fps)), len(views)))
                head = pa.array([x[: checked // 8] for x in batch.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(again), head.take(again)], ["key", "rep", "fp"])

    return run


def _near(fps: np.ndarray, coordinates: np.ndarray | None, a: np.ndarray, b: np.ndarray | int, radius: int) -> np.ndarray:
    """The places in a at which fingerprints a and b lie within radius; by pivot distances first, then by bits."""
    some = np.arange(len(a))
    other = np.broadcast_to(b, len(a))
    if coordinates is not None:
        some = np.flatnonzero(np.abs(coordinates[a] - coordinates[other]).max(axis=1, initial=0) <= radius)
    return some[np.bitwise_count(fps[a[some]] ^ fps[other[some]]).sum(axis=1) <= radius]


def _prunes(bits: int, radius: int) -> bool:
    """Whether pivot distances of unrelated fingerprints, of standard deviation sqrt(bits) / 2, differ by more than the
    radius at all often."""
    return radius < 4 * (bits / 2) ** 0.5


def _stars(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between rows a and b, the smallest name that each other row's links lead to, and that row's name."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least, before = names[rows], None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
    other = names[rows] != least
    return least[other], names[rows][other]


def _forest(names: np.ndarray, fps: np.ndarray, coordinates: np.ndarray | None, radius: int, named: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected in one bucket: of each tree, those to its smallest name.

    named: rows of one name are connected already.
    """
    out, left = [], np.arange(len(names))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        tree, met = [front[0]], set()
        while front and len(left):
            f = front.pop()
            hit = _near(fps, coordinates, left, f, radius)
            if named and names[f] not in met:
                met.add(names[f])
                hit = np.union1d(hit, np.flatnonzero(names[left] == names[f]))
            if len(hit):
                near = left[hit].tolist()
                left = np.delete(left, hit)
                tree.extend(near)
                front.extend(near)
        found = np.unique(names[tree])
        out.append((np.full(len(found) - 1, found[0]), found[1:]))
    return out


def _small_buckets(names: np.ndarray, fps: np.ndarray, coordinates: np.ndarray | None, end: np.ndarray, longest: int, use: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as of _forest() within buckets of up to _SMALL rows, a bucket's rows ending at `end`: all buckets at once."""
    row = np.flatnonzero(use)
    a, b = [row[:0]], [row[:0]]
    for step in range(1, longest):
        row = row[row + step < end[row]]
        near = row[_near(fps, coordinates, row, row + step, radius)]
        a.append(near)
        b.append(near + step)
    return _stars(names, np.concatenate(a), np.concatenate(b))


def links(nodes: DataFrame, views: list[np.ndarray] | None = None, bits: int = BITS, radius: int = RADIUS, bucket: int = BUCKET, checked: int | None = None) -> DataFrame:
    """(a, b): links between rows (rep, fp) of distinct fingerprints that connect what lies within `radius` bits and
    agrees in a view; rep is a whole number that names the fingerprint.

    checked: the radius holds for so many of the bits, and only those move to the buckets.

    What a bucket connects is linked to its smallest rep, so that views which show the same give the same links.  The
    parts of a bucket of over `bucket` rows are compared by themselves first.  Only a bucket whose rows are then still in more
    than one component has its parts meet, and what is linked there are components: links grow with the rows, not with
    the pairs of parts.
    """
    views = exact_views(bits, radius) if views is None else views
    checked = checked or bits
    table = nodes.select("rep", "fp").mapInArrow(_place(views, bits, checked), "key long, rep long, fp binary")
    pivots = _pivots(checked) if _prunes(checked, radius) else None
    sizes = written(table.groupBy("key").count().where(F.col("count") > bucket), "large-buckets")
    if sizes.isEmpty():
        return _compared(table.withColumns({"lo": F.lit(0), "hi": F.lit(0), "name": F.col("rep")}), pivots, radius, False)

    part = F.pmod(F.xxhash64("rep"), F.coalesce(F.ceil(F.col("count") / bucket).cast("int"), F.lit(1))).cast("int")
    parts = joined(table, sizes, "key", "left").withColumn("lo", part).withColumns({"hi": F.col("lo"), "name": F.col("rep")})
    stars = written(connected_components(_compared(parts, pivots, radius, False)).select(F.col("component").alias("name"), F.col("node").alias("rep")), "parts-linked")
    large = joined(joined(table, sizes, "key").drop("count"), stars, "rep", "left").withColumn("name", F.coalesce("name", "rep"))
    mixed = written(large.groupBy("key").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("key"), "buckets-apart")
    apart = paired_blocks(written(joined(large, mixed, "key"), "parts-apart"), "key", F.col("rep"), bucket).where("lo < hi")
    return stars.select(F.col("name").alias("a"), F.col("rep").alias("b")).where("a <> b").union(_compared(apart, pivots, radius, True)).distinct()


def _compared(table: DataFrame, pivots: np.ndarray | None, radius: int, named: bool) -> DataFrame:
    """(a, b): links between names from the buckets (key, lo, hi) of rows (rep, fp, name)."""
    order = ["key", "lo", "hi"]
    table = table.select(*order, "name", "fp").repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in itertools.chain(batches, [None]):
            if batch is None and kept is None:
                return
            if batch is None:
                (rows, fps), kept = kept, None
            else:
                rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
                fps = as_words(batch.column(4))
                if kept is not None:
                    rows, fps = np.concatenate([kept[0], rows], axis=1), np.concatenate([kept[1], fps])
                kept = None
                if not rows.shape[1]:
                    continue
            first = np.concatenate([[0], np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1])
            if batch is not None:  # the last bucket may go on in the next batch
                end = first[-1]
                kept, rows, fps, first = (rows[:, end:], fps[end:]), rows[:, :end], fps[:end], first[:-1]
                if not rows.shape[1]:
                    continue
            names = rows[3]
            size = np.diff(np.append(first, len(names)))
            coordinates = None if pivots is None else _distances(fps, pivots)
            out = [_small_buckets(names, fps, coordinates, np.repeat(first + size, size), int(size[size <= _SMALL].max(initial=0)), np.repeat(size, size) <= _SMALL, radius)]
            for s, n in zip(first[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
                out.extend(_forest(names[s : s + n], fps[s : s + n], None if coordinates is None else coordinates[s : s + n], radius, named))
            a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return table.mapInArrow(lambda batches: released(compare(batches)), "a long, b long").distinct()


def labelled(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """The columns of nodes (rep, least, ...), one row for each rep, and component: the smallest `least` of all nodes of
    its component (node, component) of reps, or its own."""
    linked = components.select(F.col("node").alias("rep"), F.col("component").alias("root"))
    linked = written(linked.join(nodes.select("rep", "least"), "rep"), "linked")
    least = written(linked.groupBy("root").agg(F.min("least").alias("component")), "least")
    found = joined(linked.select("rep", "root"), least, "root").select("rep", "component")
    return written(nodes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "least")), "labelled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component) by 64-bit fingerprints within radius, none missed.

    fp is the fingerprint as 16 hexadecimal digits; component is the smallest id that links lead to, its own included.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # a fingerprint is named by a number of its own: equal fingerprints meet in one partition
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")).withColumn("rep", F.monotonically_increasing_id()), "distinct-fingerprints")
    found = labelled(nodes, connected_components(links(nodes, radius=radius, bucket=bucket)))
    return joined(fps, found.select("fp", "component"), "fp").select("id", _hex(F.col("fp")).alias("fp"), "component")


def _hex(fp: Column) -> Column:
    """Little-endian bytes as one number in hexadecimal digits."""
    pairs = F.transform(F.sequence(F.lit(BITS // 8), F.lit(1), F.lit(-1)), lambda k: F.hex(fp.substr(k, F.lit(1))))
    return F.lower(F.array_join(pairs, ""))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of texts whose sets of shingles have this Jaccard similarity or more: see shingle_sets."""
    from strandmill.llm import shingle_sets

    return shingle_sets.similar_texts(docs, id_col, text_col, shingle, similarity)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its component of similar_texts().

    Rows that share an id are one document and stay or go together; rows without an id stay.
    """
    found = similar_texts(docs, id_col, text_col, shingle, similarity)
    gone = written(found.where(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct(), "gone")
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, id_col, "left_anti").select(*docs.columns)
