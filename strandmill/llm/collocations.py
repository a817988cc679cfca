"""Phrases whose words occur together more often than apart, by vertical positional inverted lists.

A text is lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs; phrases
lie within pieces.  Everything is per part of the corpus (language).  Each task packs what it reads into blocks of one
part: a number for each place of a word, one unused place between pieces.  In a block, a list holds the sorted places at
which frequent phrases of k words start, and which they are; lists start with the frequent words.  Round k merges that
list with the postings of the next word; as a phrase is no more frequent than what it ends in, those are of use only
where they end a frequent phrase that starts one place on, so they are read off the list itself.  That gives the
places of phrases of k + 1 words; their number in all blocks, the lists' length, is the exact frequency.  Blocks send their phrases and counts, packed, to buckets by hash; a bucket adds up and sends the
numbers of phrases frequent in the whole part back to the blocks that have them.  Phrases are known by those numbers,
given anew each round, so their identity is exact.  Blocks are cut between pieces, so neither a long text nor a large part
is one block; a block holds BLOCK_BYTES of text or one piece.  A bucket has about ENTRIES entries; of one phrase it
can have as many as there are blocks, so beyond SHARE_BLOCKS of them buckets are divided by blocks and added up twice.

The score of a phrase is that of its lowest cut into two parts, floor(1000 a n / (l r)) in decimals.  Phrases contained
in one that is as frequent are dropped; it is enough to look one word further, as frequency never rises with length.

Null texts are empty; null parts are `und`.  Ids play no role, repeated rows count each.  No documents give no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm._shared import released, written

LEAST, MOST_WORDS, TOP, FACTOR = 100, 5, 2000, 1000
#: Bytes of text in a block, and of text that is cut into words at once.
BLOCK_BYTES, _CHUNK = 8 << 20, 1 << 20
#: Entries (a phrase in a block) of a bucket, and blocks whose entries of one phrase are added up at once.
ENTRIES, SHARE_BLOCKS = 1 << 20, 1 << 20
#: Phrases of a part that are ranked in one task.
RANKED_ROWS = 100_000
#: A byte that no text has stands for all that ends a piece.
_END = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
#: Tables of blocks, of lists, and of what blocks send to buckets and get back.
_BLOCK = "block long, part string, size long, total long, places binary, words binary, n binary"
_LIST = "block long, size long, starts binary, phrases binary, first binary, last binary, n binary"
_CELL = "bucket int, share int, block long, part string, size long, first binary, last binary, n binary"
_COUNTED = "block long, bucket int, ids binary, id array<long>, part array<string>, word array<string>, first array<long>, last array<long>, a array<long>"


def _packed(x: np.ndarray) -> bytes:
    """Numbers, low bytes together and high bytes together, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _array(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _rows(kind: str, rows: list[dict]) -> pa.RecordBatch:
    """A batch of rows of simple values."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ") for f in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[t]) for c, t in fields], [c for c, _ in fields])


class _Words:
    """Places of one part's words as they are read: numbers of words, -1 between pieces."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.end = self.number[_END]
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        tokens = data.replace(_END, b" " + _END + b" ").split()
        self.codes.append(np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens)))
        self.codes.append(np.array([self.end], np.int32))
        self.size += len(data)

    def block(self, number: int, part: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        codes = codes[(codes != self.end) | np.append(True, codes[:-1] != self.end)]  # one place between pieces is enough
        words = list(self.number)[1:]
        n = np.bincount(codes, minlength=len(words) + 1)[1:]
        return _rows(_BLOCK, [{"block": number, "part": part, "size": len(words), "total": int(n.sum()), "places": _packed(codes.astype(np.int64) - 1), "words": zstandard.compress(_END.join(words), 1), "n": _packed(n)}])


def _chunks(text: str) -> Iterator[bytes]:
    """The text in bytes, translated; a long one in parts that end with a piece."""
    data, at = text.encode().translate(_TABLE), 0
    while len(data) - at > _CHUNK and (cut := data.find(_END, at + _CHUNK)) >= 0:
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def _blocks(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Words] = {}
        numbers = count(TaskContext.get().partitionId() << 32)
        held = 0
        for batch in batches:
            for part, text in zip(batch.column(0), batch.column(1), strict=True):
                part = part.as_py()
                for data in _chunks(text.as_py()):
                    words = open_.setdefault(part, _Words())
                    words.add(data)
                    held += len(data)
                    if words.size >= size:
                        held -= words.size
                        yield open_.pop(part).block(next(numbers), part)
                    if held >= 2 * size:  # many small parts
                        for name in list(open_):
                            yield open_.pop(name).block(next(numbers), name)
                        held = 0
        for name, words in open_.items():
            yield words.block(next(numbers), name)

    return lambda batches: released(run(batches))


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end of the last."""
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1, [len(sorted_)]]) if len(sorted_) else np.zeros(1, np.int64)


def _words(data: bytes) -> list[bytes]:
    text = zstandard.decompress(data)
    return text.split(_END) if text else []


def _dealt(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each entry of a block's list, and the order in which entries are sent."""
    if "words" in row:
        words = _words(row["words"])
        bucket = pd.util.hash_array(np.array(words, object), categorize=False) % np.uint64(buckets) if words else np.zeros(0)
        bucket = bucket.astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")
    first, last = _array(row["first"]), _array(row["last"])
    h = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((h ^ h >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.lexsort((last, first, bucket))


def _cells(buckets: int, shares: int):
    """A block's entries by bucket: keys (words, or numbers of two phrases) and counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bucket, order = _dealt(row, buckets)
                at, n = _starts(bucket[order]), _array(row["n"])
                words = np.array(_words(row["words"]), object) if "words" in row else None
                keys = None if words is not None else [_array(row[c]) for c in ("first", "last")]
                cells = []
                for a, b in itertools.pairwise(at.tolist()):
                    own = order[a:b]
                    first = zstandard.compress(_END.join(words[own]), 1) if words is not None else _packed(np.diff(keys[0][own], prepend=0))
                    last = None if words is not None else _packed(keys[1][own])
                    cells.append({"bucket": int(bucket[own[0]]), "share": row["block"] % shares, "block": row["block"], "part": row.get("part"), "size": b - a, "first": first, "last": last, "n": _packed(n[own])})
                for part in range(0, len(cells), 1000):
                    yield _rows(_CELL, cells[part : part + 1000])

    return run


class _Entries:
    """The entries of cells, in the cells' order, and which of them are alike."""

    def __init__(self, cells: pa.Table):
        self.sizes = cells.column("size").to_numpy()
        self.cell = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.n = self._numbers(cells, "n")
        self.words: np.ndarray | None = None
        if len(cells) and cells.column("last")[0].as_py() is None:
            self.words = np.array([w for x in cells.column("first") for w in _words(x.as_py())], object)
            self.part = cells.column("part").to_numpy(zero_copy_only=False)
            a, b = pd.factorize(self.words)[0], pd.factorize(self.part)[0][self.cell]
        else:
            firsts = [np.cumsum(_array(x.as_py())) for x in cells.column("first")]
            a = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            b = self._numbers(cells, "last")
        self.first, self.last = a, b
        self.order = np.lexsort((b, a))
        new = np.ones(len(self.order), bool)
        new[1:] = (a[self.order][1:] != a[self.order][:-1]) | (b[self.order][1:] != b[self.order][:-1])
        self.at = np.flatnonzero(new)
        self.sums = np.add.reduceat(self.n[self.order], self.at) if len(self.at) else np.zeros(0, np.int64)

    @staticmethod
    def _numbers(cells: pa.Table, column: str) -> np.ndarray:
        found = [_array(x.as_py()) for x in cells.column(column)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def keys(self, groups: np.ndarray) -> dict:
        """part, word, first and last of some groups of like entries."""
        own = self.order[self.at[groups]]
        if self.words is None:
            return {"part": [None] * len(own), "word": [None] * len(own), "first": self.first[own].tolist(), "last": self.last[own].tolist()}
        return {"part": self.part[self.cell[own]].tolist(), "word": [w.decode() for w in self.words[own]], "first": [0] * len(own), "last": [0] * len(own)}

    def told(self, numbers: np.ndarray, cells: pa.Table) -> list[dict]:
        """The cells that have frequent entries, with the numbers of all of theirs; numbers: by group, 0 for what is not frequent."""
        entry = np.zeros(len(self.order), np.int64)
        entry[self.order] = np.repeat(numbers, np.diff(np.append(self.at, len(self.order))))
        ends = np.cumsum(self.sizes)
        blocks, buckets = cells.column("block").to_pylist(), cells.column("bucket").to_pylist()
        return [{"block": blocks[k], "bucket": buckets[k], "ids": _packed(entry[ends[k] - self.sizes[k] : ends[k]])} for k in np.unique(self.cell[entry > 0]).tolist()]


def _table(rows: list[dict]) -> pa.Table:
    """Rows of _COUNTED."""
    kinds = {"block": pa.int64(), "bucket": pa.int32(), "ids": pa.binary(), "id": pa.list_(pa.int64()), "part": pa.list_(pa.string()), "word": pa.list_(pa.string()), "first": pa.list_(pa.int64()), "last": pa.list_(pa.int64()), "a": pa.list_(pa.int64())}
    return pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()})


def _counted(least: int, buckets: int):
    """Of a bucket: to each block the numbers of its entries, and a row (block -1) of what is frequent."""

    def run(cells: pa.Table) -> pa.Table:
        entries, bucket = _Entries(cells), cells.column("bucket")[0].as_py()
        frequent = np.flatnonzero(entries.sums >= least)
        numbers = np.zeros(len(entries.at), np.int64)
        numbers[frequent] = np.arange(len(frequent)) * buckets + bucket + 1
        known = {"block": -1, "bucket": bucket, "id": numbers[frequent].tolist(), "a": entries.sums[frequent].tolist(), **entries.keys(frequent)}
        return _table([*entries.told(numbers, cells), known])

    return run


def _summed(cells: pa.Table) -> pa.Table:
    """Of a bucket's share: its keys and their sums, by part, as if they were a block's."""
    entries = _Entries(cells)
    keys = entries.keys(np.arange(len(entries.at)))
    part = pd.Series(keys["part"], dtype=object)
    rows = []
    for name, own in part.groupby(part.fillna(""), sort=True).indices.items():
        if entries.words is None:
            first, last = _packed(np.diff(np.array(keys["first"], np.int64)[own], prepend=0)), _packed(np.array(keys["last"], np.int64)[own])
        else:
            first, last = zstandard.compress(_END.join(keys["word"][k].encode() for k in own), 1), None
        rows.append({"bucket": cells.column("bucket")[0].as_py(), "share": 0, "block": -2, "part": name, "size": len(own), "first": first, "last": last, "n": _packed(entries.sums[own])})
    return pa.Table.from_batches([_rows(_CELL, rows)])


def _told(cells: pa.Table, frequent: pa.Table) -> pa.Table:
    """Of a bucket's share and what is frequent in the bucket: to each block the numbers of its entries."""
    entries = _Entries(cells)
    number = {}
    for r in frequent.to_pylist():
        number.update(zip(zip(r["part"], r["word"], r["first"], r["last"], strict=True), r["id"], strict=True))
    keys = entries.keys(np.arange(len(entries.at)))
    numbers = np.array([number.get(x, 0) for x in zip(keys["part"], keys["word"], keys["first"], keys["last"], strict=True)], np.int64)
    return _table(entries.told(numbers, cells)).select(["block", "bucket", "ids"])


def _frequent(table: DataFrame, columns: list[str], least: int, entries: int, share_blocks: int) -> tuple[DataFrame, DataFrame, int]:
    """(block, found) of the numbers that blocks get back by bucket, (id, part, word, first, last, a) of what is frequent, and
    the number of buckets."""
    size = table.agg(F.sum("size").alias("n"), F.count("*").alias("blocks")).first()
    buckets, shares = max(1, -(-(size["n"] or 0) // entries)), max(1, -(-size["blocks"] // share_blocks))
    cells = table.select("block", "n", *columns).mapInArrow(lambda batches: released(_cells(buckets, shares)(batches)), _CELL)
    if shares == 1:
        told = written(cells.groupBy("bucket").applyInArrow(_counted(least, buckets), _COUNTED), "frequent")
        known, back = told.where("block = -1"), told.where("block >= 0")
    else:
        sums = cells.groupBy("bucket", "share").applyInArrow(_summed, _CELL)
        known = written(sums.groupBy("bucket").applyInArrow(_counted(least, buckets), _COUNTED).where("block = -1"), "frequent")
        every = known.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "id", "part", "word", "first", "last")
        back = written(cells.groupBy("bucket", "share").cogroup(every.groupBy("bucket", "share")).applyInArrow(_told, "block long, bucket int, ids binary"), "told")
    rows = known.select(F.explode(F.arrays_zip("id", "part", "word", "first", "last", "a")).alias("x")).select("x.*")
    return back.groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("found")), rows, buckets


def _known(row: dict, buckets: int) -> np.ndarray:
    """The numbers of a block's entries, 0 for those that are not frequent."""
    bucket, order = _dealt(row, buckets)
    at = _starts(bucket[order])
    begin = dict(zip(bucket[order[at[:-1]]].tolist(), at[:-1].tolist(), strict=True))
    out = np.zeros(len(order), np.int64)
    for cell in row["found"]:
        ids = _array(cell["ids"])
        out[order[begin[cell["bucket"]] : begin[cell["bucket"]] + len(ids)]] = ids
    return out


def _extended(block: int, starts: np.ndarray, phrases: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Places of phrases one word longer than those that start at `starts` (sorted), and their numbers of occurrences in
    this block.  phrases: places in ids."""
    at = np.full(int(starts[-1]) + 2 if len(starts) else 2, -1, np.int32)  # the list, by place
    at[starts] = phrases
    rest = at[starts + 1]
    both = rest >= 0
    starts, phrases, rest = starts[both], phrases[both], rest[both]
    # a phrase and the one that starts a place later, which ends with the word that is added, make the longer one
    _, where, which, n = np.unique(phrases.astype(np.int64) * max(1, len(ids)) + rest, return_index=True, return_inverse=True, return_counts=True)
    return _rows(_LIST, [{"block": block, "size": len(n), "starts": _packed(np.diff(starts, prepend=0)), "phrases": _packed(which), "first": _packed(ids[phrases[where]]), "last": _packed(ids[rest[where]]), "n": _packed(n)}])


def _longer(buckets: int):
    """The lists of one word more, from blocks, or lists, and the numbers of what is frequent in them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = _known(row, buckets)
                if "places" in row:
                    phrases = _array(row["places"])
                    starts = np.flatnonzero(phrases >= 0)
                    phrases = phrases[starts]
                else:
                    starts, phrases = np.cumsum(_array(row["starts"])), _array(row["phrases"])
                kept = ids[phrases] > 0
                yield _extended(row["block"], starts[kept].astype(np.int32), phrases[kept].astype(np.int32), ids)

    return run


def phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, text_col: str = "text", part_col: str = "lang", block_bytes: int = BLOCK_BYTES, entries: int = ENTRIES, share_blocks: int = SHARE_BLOCKS) -> list[DataFrame]:
    """Per length from 1: (id, part, phrase, a, heads, tails[, first, last]) of phrases with at least `least` occurrences.

    heads and tails hold the frequencies of what it begins and ends with, by length; first and last are the numbers of
    the phrases one word shorter.  The words' table comes with n, all occurrences of words in the part.
    """
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = written(rows.mapInArrow(_blocks(block_bytes), _BLOCK), "blocks")
    totals = table.groupBy("part").agg(F.sum("total").alias("n"))
    keys, places = ["words"], ["places"]
    out: list[DataFrame] = []
    for k in range(1, most_words + 1):
        found, new, buckets = _frequent(table, ["part", *keys] if k == 1 else keys, least, entries, share_blocks)
        if k == 1:
            named = new.select("id", "part", F.col("word").alias("phrase"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
        else:
            begin = out[-1].select(F.col("id").alias("first"), "part", F.col("phrase").alias("head"), F.col("heads").alias("before"))
            end = out[-1].select(F.col("id").alias("last"), F.element_at(F.split("phrase", " "), -1).alias("word"), F.col("tails").alias("after"))
            both = new.drop("part", "word").join(begin.hint("merge"), "first").join(end.hint("merge"), "last")
            more = lambda c: F.concat(c, F.array("a"))
            named = both.select("id", "first", "last", "part", F.concat_ws(" ", "head", "word").alias("phrase"), "a", more("before").alias("heads"), more("after").alias("tails"))
        out.append(written(named, "phrases"))
        if k < most_words:
            step = _longer(buckets)
            given = table.select("block", *keys, *places).join(found.hint("merge"), "block")
            table = written(given.mapInArrow(lambda batches, step=step: released(step(batches)), _LIST), "lists")
            keys, places = ["first", "last"], ["starts", "phrases"]
    out[0] = out[0].join(F.broadcast(totals), "part")  # a row for each part
    return out


def _score(k: int):
    """The lowest of the cuts of a phrase of k words, as (score, words before the cut, l, r)."""
    whole = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    cuts = []
    for cut in range(1, k):
        left, right = F.element_at("heads", cut), F.element_at("tails", k - cut)
        top = (whole("a") * whole("n")).cast("decimal(34,0)") * F.lit(FACTOR).cast("decimal(4,0)")
        below = (whole(left) * whole(right)).cast("decimal(38,0)")
        cuts.append(F.struct(F.call_function("div", top.cast("decimal(38,0)"), below).alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, text_col: str = "text", part_col: str = "lang", block_bytes: int = BLOCK_BYTES, entries: int = ENTRIES, share_blocks: int = SHARE_BLOCKS) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): each part's `top` phrases by score, frequency and spelling."""
    tables = phrases(docs, least, most_words, text_col, part_col, block_bytes, entries, share_blocks)
    totals = F.broadcast(tables[0].select("part", "n").distinct())
    scored = None
    for k, table in enumerate(tables[1:], 2):
        if k < most_words:
            longer = tables[k]
            as_frequent = longer.select(F.col("first").alias("id"), "a").union(longer.select(F.col("last").alias("id"), "a")).distinct()
            table = table.join(as_frequent, ["id", "a"], "left_anti")
        rows = table.join(totals, "part").withColumn("s", _score(k)).select("part", "phrase", "a", "s.l", "s.r", "n", "s.score")
        scored = rows if scored is None else scored.union(rows)
    return ranked(written(scored, "scored"), top)


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first rows of each part; a large part's are ranked in shares first, of which only the first can be first in all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = sum(r["count"] for r in scored.groupBy("part").count().orderBy(F.desc("count")).limit(1).collect())
    while rows > RANKED_ROWS + 2 * top:
        shares = -(-rows // (RANKED_ROWS + 2 * top))
        by = Window.partitionBy("part", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).drop("rank")
        rows = shares * top
    by = Window.partitionBy("part").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top).select("part", "rank", "phrase", "a", "l", "r", "n", "score")
