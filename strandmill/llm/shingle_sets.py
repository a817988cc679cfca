"""Near-duplicates by the exact Jaccard similarity of texts' sets of shingles, among candidates from fingerprints.

Texts with equal sets are one node, named by a hash of the set.  Candidates come from the fingerprints of the sets:
simhash.links() finds what lies within a radius and agrees in one of many sampled views, by tables of pivot distances.
Radius and views are worked out so that a pair at just the similarity is a candidate with probability RECALL, whatever
the lengths of its texts and the number of texts; a pair above it more often.  A candidate links only if its sets,
fetched by joins, reach the similarity.

What candidates connect is a group.  Of a small group all pairs are verified.  The nodes of a large one are first compared
with a centre each, and what that connects is one component; where a group's nodes are then still in more than one, the
sets themselves are brought together in blocks and all compared, so that no link between components is lost.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import simhash
from strandmill.llm._bytes import LOWER, chunks, text_array, text_bytes
from strandmill.llm._shared import connected_components, joined, paired_blocks, released, written

#: Bits of a set's fingerprint, those of them that pairs are checked by, and the probability that a pair at just the
#: similarity is a candidate.
BITS, CHECKED, RECALL = 512, 256, 0.99
#: Unrelated fingerprints that share a node's key in a view, on average: fewer bits in a view need fewer views.
LOAD = 32
#: Largest group of which all pairs are candidates, and nodes with one centre in a larger group.
SMALL, AROUND = 16, 64
#: Largest number of sets that are dealt to a block (long ones count as several); two meet in a task.
BLOCK, SET_WORDS = 1024, 1024
#: Bits of the map of texts whose sets are needed: what is broadcast has this size, however many there are.
MAP_BITS = 1 << 26


#: Multipliers that make 8 bytes of weights each from a hash.
_FACTORS = np.random.default_rng(512).integers(0, 2**64, BITS // 8, dtype=np.uint64) | np.uint64(1)
_EVEN_BYTES = np.uint64(0x00FF00FF00FF00FF)


def signs(found: np.ndarray) -> bytes:
    """The fingerprint of a set of hashes: the signs of sums of weights, which are bytes made from the hashes, less
    their mean.

    Weights of many sizes make the sets' bits differ as often as the sets' angle says, however small they are.
    """
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 256):  # as many bytes as 16 bits can sum
        weights = found[at : at + 256, None] * _FACTORS
        weights ^= weights >> np.uint64(32)
        even = (weights & _EVEN_BYTES).sum(axis=0)
        weights >>= np.uint64(8)
        weights &= _EVEN_BYTES
        total += np.concatenate([even, weights.sum(axis=0)]).astype("<u8").view("<u2")
    return np.packbits(2 * total > 255 * len(found), bitorder="little").tobytes()


@functools.cache
def differing(similarity: float) -> float:
    """The largest probability that one bit differs in the fingerprints of two sets of this similarity or more.

    Between large sets it tends to the angle of equally large ones, over pi; among small sets it is drawn.
    """
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    rng = np.random.default_rng(BITS)
    for both in range(1, 25):
        apart = int(both * (1 / similarity - 1) + 1e-9)
        weights = 2 * rng.integers(0, 256, (100_000, both + apart)) - 255
        shared = weights[:, :both].sum(axis=1)
        for one in range((apart + 1) // 2, apart + 1):
            a, b = shared + weights[:, both : both + one].sum(axis=1), shared + weights[:, both + one :].sum(axis=1)
            most = max(most, float(((a > 0) != (b > 0)).mean()))
    return most + 0.002  # three standard deviations of the draws


def _distances(similarity: float, bits: int) -> np.ndarray:
    """Probability of each distance between fingerprints at this similarity."""
    p = differing(similarity)
    return np.array([math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(bits + 1)])


def radius_for(similarity: float, bits: int = CHECKED, recall: float = RECALL) -> int:
    """The distance that all but a tenth of what recall gives up stay within."""
    return int(np.searchsorted(np.cumsum(_distances(similarity, bits)), 1 - 0.1 * (1 - recall)))


def views_for(nodes: int, similarity: float, bits: int = BITS, recall: float = RECALL) -> list[np.ndarray]:
    """Random sets of bits in one of which a pair at this similarity agrees with probability recall.

    They grow in number about as the nodes do to the power of 0.35 at a similarity of 0.8.
    """
    size = min(bits, max(1, math.ceil(math.log2(max(nodes, 1) / LOAD)))) if nodes > LOAD else 1
    share = _distances(similarity, bits) * (1 - 0.2 * (1 - recall))  # the rest both radii may give up
    agree = np.array([math.comb(bits - d, size) / math.comb(bits, size) for d in range(bits + 1)])
    n = 1
    while float((share * (1 - (1 - agree) ** n)).sum()) < recall:
        n = n + 1 + n // 32
    rng = np.random.default_rng([bits, size])
    return [np.sort(rng.choice(bits, size, replace=False)) for _ in range(n)]


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Name and distinct shingle hashes of each text."""
    buf, bounds = text_bytes(text_array(texts))
    for i, j in chunks(bounds):
        lower = LOWER[buf[bounds[i] : bounds[j]]].tobytes()
        at = bounds[i : j + 1] - bounds[i]
        for a, b in itertools.pairwise(at.tolist()):
            found = np.unique(simhash.shingle_hashes(lower[a:b], shingle))
            yield xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63, found


def _keyed(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """more, key (a hash of the text) and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*[F.col(c).alias("id") for c in more], F.xxhash64(text).alias("key"), text.alias("text"))


def _named(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, key, rep, fp): the text's hash, the node of each row and its fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(rep, signs(s)) for rep, s in _sets(batch.column(2), shingle)]
            out = [*batch.columns[:2], pa.array([rep for rep, _ in found], pa.int64()), pa.array([fp for _, fp in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["id", "key", "rep", "fp"])

    return _keyed(docs, text_col, id_col).mapInArrow(lambda batches: released(scan(batches)), f"id {kind}, key long, rep long, fp binary")


def _needed(docs: DataFrame, text_col: str, shingle: int, keys: DataFrame) -> DataFrame:
    """(rep, words): the sets of the texts with these keys, and of some others."""
    bit = keys.select(F.pmod("key", F.lit(MAP_BITS)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 5).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toArrow()
    marked = np.zeros(MAP_BITS // 32, np.uint32)
    marked[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            key = batch.column(0).to_numpy() % MAP_BITS
            use = (marked[key >> 5] >> (key & 31).astype(np.uint32)) & 1
            kept = list(_sets(batch.column(1).filter(pa.array(use.astype(bool))), shingle))
            ends = np.concatenate([[0], np.cumsum([len(s) for _, s in kept])]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(s.view(np.int64) for _, s in kept)])))
            yield pa.RecordBatch.from_arrays([pa.array([rep for rep, _ in kept], pa.int64()), sets], ["rep", "words"])

    once = _keyed(docs, text_col).mapInArrow(lambda batches: released(scan(batches)), "rep long, words array<long>")
    return once.groupBy("rep").agg(F.first("words").alias("words"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    one, other = (sets.select(F.col("rep").alias(k), F.col("words").alias(f"words_{k}")) for k in "ab")
    both = F.size(F.array_intersect("words_a", "words_b"))
    return pairs.join(one, "a").join(other, "b").where(both / (F.size("words_a") + F.size("words_b") - both) >= F.lit(similarity)).select("a", "b")


def _forest(rep: np.ndarray, fps: np.ndarray, words: np.ndarray, size: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the similarity connects among sets laid end to end, each in order.

    Pairs that are connected already, too unlike in size or further apart than the radius are not looked at.
    """
    ends = np.cumsum(size)
    label = np.arange(len(rep))
    a, b = [], []
    for k in range(len(rep) - 1):
        rest = np.arange(k + 1, len(rep))
        rest = rest[(label[rest] != label[k]) & (np.minimum(size[rest], size[k]) >= similarity * np.maximum(size[rest], size[k]))]
        rest = rest[np.bitwise_count(fps[rest] ^ fps[k]).sum(axis=1) <= radius]
        own = words[ends[k] - size[k] : ends[k]]
        for j in rest.tolist():
            if label[j] == label[k]:
                continue
            other = words[ends[j] - size[j] : ends[j]]
            at = np.searchsorted(own, other)
            both = int((own[np.minimum(at, len(own) - 1)] == other).sum()) if len(own) else 0
            if both >= similarity * (size[k] + size[j] - both):
                a.append(rep[k])
                b.append(rep[j])
                label[label == label[j]] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _all_compared(apart: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) within groups of many nodes (key, rep)."""
    own = apart.select("key", "rep").join(nodes.select("rep", "fp"), "rep").join(sets, "rep").withColumn("weight", 1 + F.size("words") / SET_WORDS)
    dealt = paired_blocks(own, "key", F.col("rep"), block, "weight")
    radius = radius_for(similarity, BITS)

    def compare(group: pa.Table) -> pa.Table:
        words, fps = (x.combine_chunks() for x in (group.column("words"), group.column("fp")))
        words, fps = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (words, fps))
        size = words.value_lengths().to_numpy().astype(np.int64)
        a, b = _forest(group.column("rep").to_numpy(), simhash.as_words(fps), words.flatten().to_numpy().view(np.uint64), size, similarity, radius)
        return pa.table({"a": a, "b": b})

    dealt = dealt.select("key", "lo", "hi", "rep", "fp", "words").repartition("key", "lo", "hi")  # or a group's blocks stay together
    return dealt.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def links(docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes (rep, fp, key) that connect all candidates at the similarity or more, and no others."""
    views = views_for(nodes.count(), similarity)
    near = simhash.links(nodes, views, BITS, radius_for(similarity), checked=CHECKED)
    groups = written(connected_components(near).select(F.col("component").alias("group"), F.col("node").alias("rep")), "groups")
    sizes = written(groups.groupBy("group").count(), "group-sizes")
    shared = written(joined(groups, sizes, "group"), "sized-groups")

    few, large = shared.where(F.col("count") <= SMALL).select("group", "rep"), shared.where(F.col("count") > SMALL)
    pairs = few.withColumnRenamed("rep", "a").join(few.withColumnRenamed("rep", "b"), "group").where("a < b").select("a", "b")
    large = large.withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("count") / AROUND)).cast("int"))
    centres = large.groupBy("group", "part").agg(F.min("rep").alias("a"))
    stars = large.join(centres, ["group", "part"]).select("a", F.col("rep").alias("b"))
    tops = joined(centres, written(centres.groupBy("group").agg(F.min("a").alias("top")), "tops"), "group").select(F.col("top").alias("a"), F.col("a").alias("b"))
    pairs = pairs.union(stars).union(tops).where("a <> b").distinct()

    sets = written(_needed(docs, text_col, shingle, nodes.join(groups, "rep", "left_semi")), "shingle-sets")
    found = written(_verified(pairs, sets, similarity), "links")
    roots = connected_components(found).withColumnRenamed("node", "rep")
    placed = written(large.select("group", "rep").join(roots, "rep", "left").select("group", "rep", F.coalesce("component", "rep").alias("root")), "placed")
    mixed = written(placed.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("group"), "groups-apart")
    apart = written(joined(placed.select(F.col("group").alias("key"), "rep"), mixed.withColumnRenamed("group", "key"), "key"), "sets-apart")
    return found.union(written(_all_compared(apart, nodes, sets, similarity, block), "links-apart"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(id, component): component is the smallest id that links lead to, its own included.

    Null and empty texts have the empty set and are one node.  Rows are never merged: repeated rows give repeated
    results.  A null id takes part, but is no component's id unless all ids in it are null.
    """
    named = written(_named(docs, id_col, text_col, shingle), "named-sets")
    nodes = written(named.groupBy("rep").agg(F.first("fp").alias("fp"), F.min("key").alias("key"), F.min("id").alias("least")), "sets")
    labelled = simhash.labelled(nodes, connected_components(links(docs, nodes, text_col, shingle, similarity, block)))
    return joined(named.select("id", "rep"), labelled.select("rep", "component"), "rep").select("id", "component")
