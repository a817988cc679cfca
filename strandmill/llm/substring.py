"""Removal of long passages that also occur earlier, found with difference-cover anchors.

A window is `WINDOW` consecutive words of one document.  Each word that lies in a window whose words also start
earlier (in a document with a smaller id, or earlier in the same one) is removed; windows are judged on the input.

The positions 0, 1, 3, 9 modulo 13 are a difference cover: for any two positions there is a shift below 13 that
takes both to cover positions.  So of two equal windows of 20 words, some 8 words at the same place in both start at
cover positions, and it is enough to hash 8 words at cover positions (anchors) to see where equal windows can be.
From repeated anchors the match extends to the windows around them, which are compared whole by a 96-bit hash.

Documents are dealt into blocks of about `BLOCK_ROWS` rows, fewer where texts are long; a block sends its anchors and
windows to hash buckets as packed arrays, each different one once, so a passage that every document holds is one entry
per block.

Null and empty texts have no words.  A null id comes after all others.  Rows that share an id, or have none, do not
remove each other's words; an earlier start within one row does.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._bytes import BLANK_SEPARATED, chunks, gram_hashes, gram_starts, scan_words, text_array, text_bytes, word_hashes
from strandmill.llm._shared import block_of, number_of_blocks, packed_blocks, unpacked

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
BLOCK_ROWS = 1024
_LAST = np.iinfo(np.int64).max
_CELLS = "bucket int, block int, known boolean, data binary"
_FLAGS = "block int, data binary"
_ANCHOR = np.dtype([("key", "<u8"), ("at", "<u4")])
_WINDOW = np.dtype([("key", "<u8"), ("more", "<u4"), ("id", "<i8"), ("at", "<u4")])


class _Block:
    """The words of a block's documents in order of id, and their hashes."""

    def __init__(self, rows: pa.Table, hashes: tuple[int, ...] = ()):
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("text", "ascending")]))
        self.id_column = rows.column("id")
        self.ids = pc.fill_null(self.id_column, _LAST).to_numpy()
        self.buf, self.bounds = text_bytes(text_array(rows.column("text")))
        first, parts = [np.zeros(1, np.int64)], [[] for _ in hashes]
        for i, j in chunks(self.bounds, 1 << 20):
            buf, bounds = self.buf[self.bounds[i] : self.bounds[j]], self.bounds[i : j + 1] - self.bounds[i]
            starts, ends, own = scan_words(buf, bounds, BLANK_SEPARATED)
            first.append(own[1:] + first[-1][-1])
            for part, seed in zip(parts, hashes, strict=True):
                part.append(word_hashes(seed, buf, starts, ends))
        self.first = np.concatenate(first)
        self.hashes = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def _cells(block: int, keys: np.ndarray, entries: np.ndarray, known: np.ndarray, buckets: int) -> pa.Table:
    """Rows of packed entries by bucket of their key, and one of the places already known to repeat."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    rows = [(int(bucket[a]), block, False, entries[a:b].tobytes()) for a, b in itertools.pairwise(at)]
    if len(known):
        rows.append((block % buckets, block, True, known.astype("<u4").tobytes()))
    kinds = [("bucket", pa.int32()), ("block", pa.int32()), ("known", pa.bool_()), ("data", pa.binary())]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)})


def _flags(blocks: np.ndarray, places: np.ndarray, known: pa.Table) -> pa.Table:
    """Per block the packed places found, and those known before."""
    order = np.argsort(blocks, kind="stable")
    blocks, places = blocks[order], places[order].astype("<u4")
    at = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]) if len(blocks) else [0]
    found = {"block": pa.array([int(blocks[a]) for a in at[:-1]], pa.int32()), "data": pa.array([places[a:b].tobytes() for a, b in itertools.pairwise(at)], pa.binary())}
    return pa.concat_tables([pa.table(found), known.select(["block", "data"]).cast(pa.schema([("block", pa.int32()), ("data", pa.binary())]))])


def _entries(cells: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a bucket and the blocks that they come from."""
    data = [x.as_py() for x in cells.column("data")]
    blocks = np.repeat(cells.column("block").to_numpy(), [len(x) // kind.itemsize for x in data])
    return np.frombuffer(b"".join(data), kind), blocks


def _places(flags: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in flags.column("data")), "<u4")


def _anchors(window: int, period: int, cover: tuple[int, ...], buckets: int):
    length = window - period + 1
    covered = np.isin(np.arange(period), cover)

    def run(cells: pa.Table) -> pa.Table:
        block = _Block(unpacked(cells), (41,))
        at = gram_starts(block.first, length)
        text = np.searchsorted(block.first, at, "right") - 1
        at = at[covered[(at - block.first[text]) % period]]
        key = gram_hashes(block.hashes[0], at, length)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        single = new.copy()
        single[:-1] &= new[1:]
        entries = np.empty(int(new.sum()), _ANCHOR)
        entries["key"], entries["at"] = key[new], at[new]
        return _cells(cells.column("block")[0].as_py(), entries["key"], entries, at[~single], buckets)

    return run


def _repeated(cells: pa.Table) -> pa.Table:
    """Places of anchors that more than one block has."""
    known = cells.filter(cells.column("known"))
    entries, blocks = _entries(cells.filter(pc.invert(cells.column("known"))), _ANCHOR)
    order = np.argsort(entries["key"], kind="stable")
    key = entries["key"][order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    return _flags(blocks[order][same], entries["at"][order][same], known)


def _windows(window: int, period: int, buckets: int):
    def run(cells: pa.Table, flags: pa.Table) -> pa.Table:
        block = _Block(unpacked(cells), (42, 43))
        anchored = np.zeros(block.first[-1] + 1, np.int32)
        anchored[_places(flags) + 1] = 1
        np.cumsum(anchored, out=anchored)
        at = gram_starts(block.first, window)
        at = at[anchored[at + period] > anchored[at]]
        key, more = (gram_hashes(h, at, window) for h in block.hashes)
        text = np.searchsorted(block.first, at, "right") - 1
        entries = np.empty(len(at), _WINDOW)
        entries["key"], entries["more"], entries["id"], entries["at"] = key, more, block.ids[text], at
        order, first = _by_words(entries)
        entries, text = entries[order], text[order]
        later = entries["id"] > entries["id"][first]
        later[1:] |= (first[1:] == first[:-1]) & (text[1:] == text[:-1])  # within a row, each but the first
        return _cells(cells.column("block")[0].as_py(), entries["key"][~later], entries[~later], entries["at"][later], buckets)

    return run


def _by_words(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by words, then id, then place; and for each place in it the first place with the same words."""
    order = np.lexsort((entries["at"], entries["id"], entries["more"], entries["key"]))
    key, more = entries["key"][order], entries["more"][order]
    new = np.ones(len(entries), bool)
    new[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def _later(cells: pa.Table) -> pa.Table:
    """Places of windows that also start earlier."""
    known = cells.filter(cells.column("known"))
    entries, blocks = _entries(cells.filter(pc.invert(cells.column("known"))), _WINDOW)
    order, first = _by_words(entries)
    entries, blocks = entries[order], blocks[order]
    # what starts later within its own row, its block knows
    later = entries["id"] > entries["id"][first]
    return _flags(blocks[later], entries["at"][later], known)


def _keep(window: int, with_text: bool):
    def run(cells: pa.Table, flags: pa.Table) -> pa.Table:
        block = _Block(unpacked(cells))
        edge = np.zeros(block.first[-1] + 1, np.int32)
        places = np.unique(_places(flags)).astype(np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + window, -1)
        kept = np.cumsum(edge)[:-1] == 0
        total = np.concatenate([[0], np.cumsum(~kept)])
        removed = total[block.first[1:]] - total[block.first[:-1]]
        texts, sums = [], []
        for k, n in enumerate(removed.tolist()):
            words = block.buf[block.bounds[k] : block.bounds[k + 1]].tobytes().split()
            if n:
                words = itertools.compress(words, kept[block.first[k] : block.first[k + 1]].tolist())
            joined = b" ".join(words)
            sums.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                texts.append(joined.decode())
        out = {"id": block.id_column, "n_words": pa.array(np.diff(block.first)), "n_removed": pa.array(removed), "kept_sha256": pa.array(sums, pa.string())}
        return pa.table(out | ({"kept": pa.array(texts, pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row: id (long), n_words, n_removed, kept_sha256 (of the kept words, joined by spaces), and kept, their text."""
    if period > window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover must be a difference cover modulo a period of at most the window")
    blocks = number_of_blocks(docs, block_rows, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = packed_blocks(rows.withColumn("block", block_of(F.col("id"), blocks))).groupBy("block")
    anchors = texts.applyInArrow(_anchors(window, period, cover, blocks), _CELLS)
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated, _FLAGS)
    windows = texts.cogroup(repeated.groupBy("block")).applyInArrow(_windows(window, period, blocks), _CELLS)
    later = windows.groupBy("bucket").applyInArrow(_later, _FLAGS)
    kind = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return texts.cogroup(later.groupBy("block")).applyInArrow(_keep(window, with_text), kind)
