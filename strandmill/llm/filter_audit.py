"""How filters of documents interact: in every order of applying them, what each removes, and what it removes alone.

Five filters, by letter: A few words, B few different words, C many capitals, D symbols, E a text that a row with a smaller
id has as well.  A to D are read off a text; E needs equal texts to meet.  Each text is routed by its xxHash64 to one
of the partitions of an RDD.  There a table by hash holds chains of texts (whole, compressed; more than one only where
hashes collide) with their smallest id, and every row that is not the smallest fails.  Before that each task settles
what it can: of equal texts that it has read only the rows of the smallest id travel with the text, the others are known to fail
and travel as numbers to any partition.  So a text that a third of all rows have costs a few rows a task.

What counts is then which of the 32 sets of filters a row fails.  Count vectors over those sets (rows, rows labelled
good, rows labelled toxic) are merged with combineByKey for each part of the corpus, and all orders follow from them.

Null and empty texts are equal, have no words, and fail A.  Rows without an id neither fail E nor make others fail it;
repeated rows with one id do not make each other fail.  A null part is the empty string.  An id counts as good (toxic)
if any of its labels says so, once for each of its rows.  No documents give no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strandmill.llm._shared import joined, number_of_blocks, written

FILTERS = "ABCDE"
_BIT = {letter: 1 << k for k, letter in enumerate(FILTERS)}
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Compressed bytes of texts that a task holds before it sends them on, and of text in a partition of the RDD.
HELD_BYTES, PARTITION_BYTES = 16 << 20, 32 << 20
PARTITION_ROWS = 50_000
SETS = 1 << len(FILTERS)


@dataclass(frozen=True)
class Limits:
    """Least words; least percentage of different words; largest percentage of capitals among code points."""

    words: int = 100
    different: int = 80
    capitals: int = 10


def failed_by_text(text: str, limits: Limits) -> int:
    """The set of filters A to D that a text fails, as bits."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes, at the six ASCII blanks
    few = len(words) < limits.words
    same = 100 * len(set(words)) < limits.different * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > limits.capitals * len(text)
    symbols = len(data.translate(None, _SYMBOLS)) < len(data)
    return few * _BIT["A"] | same * _BIT["B"] | loud * _BIT["C"] | symbols * _BIT["D"]


class _Chains:
    """Texts of hashes, with the smallest id seen and the number of its rows by part."""

    def __init__(self) -> None:
        self.table: dict[int, list[list]] = {}
        self.held = 0

    def add(self, key: int, text: bytes, mask: int, id_: int, part: str, n: int) -> Iterator[tuple]:
        """Takes rows of a compressed text; gives what they settle, as (id, part, mask, n)."""
        chain = self.table.setdefault(key, [])
        entry = next((e for e in chain if e[0] == text or zlib.decompress(e[0]) == zlib.decompress(text)), None)
        if entry is None:
            chain.append(entry := [text, mask, id_, {}])
            self.held += len(text)
        if id_ > entry[2]:
            yield id_, part, mask | _BIT["E"], n
            return
        if id_ < entry[2]:
            for other, rows in entry[3].items():
                yield entry[2], other, mask | _BIT["E"], rows
            entry[2:] = id_, {}
        entry[3][part] = entry[3].get(part, 0) + n

    def smallest(self) -> Iterator[tuple]:
        """(key, text, mask, id, part, n) of what is left, which is forgotten."""
        for key, chain in self.table.items():
            for text, mask, id_, rows in chain:
                for part, n in rows.items():
                    yield key, text, mask, id_, part, n
        self.table, self.held = {}, 0


def _routed(rows: Iterable[Row], limits: Limits) -> Iterator[tuple[int, tuple]]:
    """By key: with a text what may be the smallest of it, else what is settled, dealt to any partition."""
    chains, spread = _Chains(), itertools.count()
    for id_, part, text, key in rows:
        mask = failed_by_text(text, limits)
        if id_ is None:
            yield next(spread), (None, mask, None, part, 1)
            continue
        for settled in chains.add(key, zlib.compress(text.encode("utf-8", "surrogatepass"), 1), mask, id_, part, 1):
            yield next(spread), (None, settled[2], settled[0], settled[1], settled[3])
        if chains.held >= HELD_BYTES:
            yield from ((k, x) for k, *x in chains.smallest())
    yield from ((k, x) for k, *x in chains.smallest())


def _settled(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(id, part, mask, n): a row fails once a smaller id of its text is known, the smallest are left at the end."""
    chains = _Chains()
    for key, (text, mask, id_, part, n) in rows:
        if text is None:
            yield id_, part, mask, n
        else:
            yield from chains.add(key, text, mask, id_, part, n)
    for _, _, mask, id_, part, n in chains.smallest():
        yield id_, part, mask, n


def failed(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): the filters that rows fail, bit k for the k-th letter; n is 1 but for repeated rows of one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("key"))
    partitions = number_of_blocks(docs, PARTITION_ROWS, text_col, PARTITION_BYTES)
    at_least = docs.sparkSession.sparkContext.defaultParallelism
    dealt = rows.rdd.mapPartitions(lambda part: _routed(part, limits)).partitionBy(max(partitions, at_least))
    return docs.sparkSession.createDataFrame(dealt.mapPartitions(_settled), "id long, part string, mask int, n long", verifySchema=False)


def _counted(rows) -> dict[str, np.ndarray]:
    """Per part rows, good rows and toxic rows by set of failed filters; a part is a row of 96 numbers."""

    def add(sums: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        sums[mask] += (n, n * good, n * toxic)
        return sums

    return rows.combineByKey(lambda row: add(np.zeros((SETS, 3), np.int64), row), add, np.add)


def _orders(part: str, sums: np.ndarray) -> Iterator[tuple]:
    """All orders of the filters and their steps."""
    sets = np.arange(SETS)
    alone = {c: int(sums[_BIT[c], 0]) for c in FILTERS}
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, c in enumerate(order, 1):
            fails, left = sets & _BIT[c] != 0, sets & before == 0
            gone, good, toxic = sums[fails & left].sum(axis=0).tolist()
            before |= _BIT[c]
            kept = int(sums[sets & before == 0, 0].sum())
            rows.append(("".join(order), step, kept, gone, int(sums[fails & ~left, 0].sum()), alone[c], good, toxic))
            total[c] += gone
    for row in rows:
        yield (part, *row, total[row[0][row[1] - 1]])


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    labels has id_col, quality and toxic.  shapley is what a filter removes, summed over all orders.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = joined(written(failed(docs, limits, id_col, text_col, part_col), "failed"), said, "id", "left")
    rows = known.select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd.map(lambda r: (r[0], tuple(r[1:])))
    kind = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    orders = _counted(rows).flatMap(lambda x: _orders(*x))
    return docs.sparkSession.createDataFrame(orders, kind, verifySchema=False)
