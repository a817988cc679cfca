"""Token ids in binary shards, compressed by a grammar of id pairs (Re-Pair).

Texts are encoded with a byte-level tokenizers file and closed by an end id.  Documents go, in ascending order of id,
into range partitions and from those into shards of about `SHARD_TOKENS` ids.  In a shard, rounds of frequent pairs of
neighbouring symbols of one document are replaced by new symbols (nonterminals), the leftmost first where pairs
overlap, until no pair occurs `FREQUENT` times; nonterminals pair up again in later rounds.

A shard is one binary value, little-endian:
    8 bytes magic, then 5 longs: documents, first nonterminal, rules, symbols, bytes per symbol (2 or 4);
    per document: long id, byte 1 if the id is null, long symbols before it;
    per rule: two symbols, and a long expansion length in ids;
    the symbols.
Documents start at a symbol, so one is decoded without the others; within it, expansion lengths lead to any position.
Shards are rows of a Parquet table in a folder that all executors share, so a lost executor loses no shard.

Null and empty texts are encoded as the end id alone.  Null ids come first.  Repeated rows are kept, each a document.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm._bytes import chunks, ragged_range, text_array, text_bytes
from strandmill.llm._pieces import Remembered

END_ID = 2
#: Segments of which one worker process remembers the ids.
REMEMBERED = 1_200_000
SHARD_TOKENS = 1_000_000
PARTITION_ROWS = 4096
FREQUENT = 16
MAGIC = b"REPAIR01"
_CHUNK = 2 << 20
_BOUNDARY = re.compile(r"(?<=\S)(?= )")
_TABLE = "part long, shard int, data binary, n_docs long, n_tokens long"
#: Range partitions whose sizes are summed together before shards are numbered through.
_GROUP = 1024


class ByteLevelEncoder:
    """Encodes texts with a byte-level tokenizers file, each different space-led segment once.

    The file's pattern never joins a space to what is before it (but for runs of white space, which stay whole
    here), so segments that start at a space after another character are encoded as they are in the text.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self._size[i] = len(piece)  # one character stands for one byte
        self._later, self._first = Remembered(self._later_ids, REMEMBERED), Remembered(self._each)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def _later_ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, given without their space: encoded as one text and cut by the pieces' bytes, but for texts
        with segments that end in white space or may hold a special token."""
        joined = " " + " ".join(keys)
        if "<|" in joined or any(k[-1:].isspace() or not k for k in keys):
            return self._each([" " + k for k in keys])
        ids = np.array(self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        length = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        data = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        size = 1 + (data > 0x7F).astype(np.int8) + (data > 0x7FF) + (data > 0xFFFF)  # bytes of each character in UTF-8
        ends = np.cumsum(size, dtype=np.int64)[np.cumsum(length) - 1]
        at = np.searchsorted(np.cumsum(self._size[ids]), ends) + 1
        return ids, np.diff(at, prepend=0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        heads, rest, sizes = [], [], []
        for t in texts:
            if "  " not in t and t[:1] != " " and t[-1:] != " ":
                own = t.split(" ")
            else:
                head, *later = _BOUNDARY.split(t)
                own = [head, *(x[1:] for x in later)]
            heads.append(own[0])
            sizes.append(len(own))
            rest += own[1:]
        first, (ids_a, n_a) = self._first(heads)
        later, (ids_b, n_b) = self._later(rest) if rest else (np.zeros(0, np.int64), (np.zeros(0, np.int32), np.zeros(0, np.int64)))
        sizes = np.array(sizes, np.int64)
        start = np.cumsum(sizes) - sizes
        number = np.empty(int(sizes.sum()), np.int64)
        is_head = np.zeros(len(number), bool)
        is_head[start] = True
        number[is_head], number[~is_head] = first, later + len(n_a)
        counts = np.concatenate([n_a, n_b])
        begin = np.cumsum(counts) - counts
        per = counts[number]
        ids = np.concatenate([ids_a, ids_b])[ragged_range(begin[number], per)]
        return ids, np.bincount(np.repeat(np.arange(len(texts)), sizes), per, len(texts)).astype(np.int64)


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def _encoder(tokenizer_json: str) -> ByteLevelEncoder:
    """The worker process's encoder, which later tasks find warm."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS[tokenizer_json] = ByteLevelEncoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


def _slots(keys: np.ndarray) -> np.ndarray:
    """16 bits of each key."""
    return (keys * keys.dtype.type(0x9E3779B97F4A7C15 >> (64 - 8 * keys.itemsize) | 1) >> keys.dtype.type(8 * keys.itemsize - 16)).astype(np.int32)


def _places(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Where each key is in ordered, which has no key twice; -1 where it is not.

    A table by slots answers but for the slots that several of ordered share, whose keys are searched for.
    """
    slots = _slots(ordered)
    table = np.full(1 << 16, -1, np.int32)
    table[slots] = np.arange(len(ordered), dtype=np.int32)
    shared = np.bincount(slots, minlength=1 << 16) > 1
    own = _slots(keys)
    out = table[own]
    out[(ordered[out] != keys) | (out < 0)] = -1
    again = np.flatnonzero(shared[own] & (out < 0))
    found = np.minimum(np.searchsorted(ordered, keys[again]), len(ordered) - 1)
    out[again] = np.where(ordered[found] == keys[again], found, -1)
    return out


def compress(ids: np.ndarray, lengths: np.ndarray, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, symbols of each document, rules (two symbols each) and the first nonterminal."""
    symbols = ids.astype(np.uint32)
    terminals = int(symbols.max(initial=0)) + 1
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules = np.zeros((0, 2), np.uint32)
    # places of pairs that may be frequent; one of two old symbols that was not frequent never becomes so
    some = np.flatnonzero(~last[:-1])
    while len(some):
        half = 16 if terminals + len(rules) <= 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        key = (symbols[some].astype(kind) << kind(half)) | symbols[some + 1].astype(kind)
        ordered = np.sort(key)
        at = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
        count = np.diff(at)
        repeated, count = ordered[at[:-1][count >= frequent]], count[count >= frequent]
        if not len(repeated):
            break
        found = _places(key, repeated)
        often = np.flatnonzero(found >= 0)
        some, found = some[often], found[often]
        where = some
        # of a run of overlapping pairs, every other one
        run = np.concatenate([[0], np.flatnonzero(np.diff(where) > 1) + 1])
        step = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
        where, found = where[step % 2 == 0], found[step % 2 == 0]
        is_used = np.bincount(found, minlength=len(repeated)) > 0
        used = np.flatnonzero(is_used)
        fresh = terminals + len(rules) - 1 + np.cumsum(is_used)
        pair = repeated[used].astype(np.uint64)
        rules = np.concatenate([rules, np.stack([pair >> np.uint64(half), pair & np.uint64((1 << half) - 1)], axis=1).astype(np.uint32)])
        symbols[where] = fresh[found]
        last[where] = last[where + 1]
        kept = np.ones(len(symbols), bool)
        kept[where + 1] = False
        open_ = np.zeros(len(symbols), bool)
        open_[some] = True
        open_[where] = True
        before = where[where > 0] - 1
        open_[before - ~kept[before]] = True  # what stands before a new symbol
        symbols, last, open_ = symbols[kept], last[kept], open_[kept]
        some = np.flatnonzero(open_[:-1] & ~last[:-1])
    ends = np.flatnonzero(last) + 1
    per = np.zeros(len(lengths), np.int64)
    per[lengths > 0] = np.diff(ends, prepend=0)
    return symbols, per, rules, terminals


def pack(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, null: np.ndarray, **how: int) -> bytes:
    """One shard."""
    symbols, per, rules, terminals = compress(ids, lengths, **how)
    size = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        size[terminals + k] = size[a] + size[b]
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = MAGIC + struct.pack("<5q", len(docs), terminals, len(rules), len(symbols), width)
    own = docs.astype("<i8").tobytes() + null.astype("u1").tobytes() + (np.cumsum(per) - per).astype("<i8").tobytes()
    return head + own + rules.astype(kind).tobytes() + size[terminals:].astype("<i8").tobytes() + symbols.astype(kind).tobytes()


class Shard:
    """Reads one shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        n, self.terminals, rules, symbols, width = struct.unpack_from("<5q", data, 8)
        at = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.docs, self.null, self.starts = take("<i8", n), take("u1", n).astype(bool), np.append(take("<i8", n), symbols)
        self.rules = take(f"<u{width}", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.sizes = np.concatenate([np.ones(self.terminals, np.int64), take("<i8", rules)])
        self.symbols = take(f"<u{width}", symbols)
        self._flat: np.ndarray | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' ids, one symbol after the other, and where each one's start."""
        first = np.cumsum(self.sizes) - self.sizes
        if self._flat is None:
            flat = np.zeros(int(self.sizes.sum()), np.int32)
            flat[: self.terminals] = np.arange(self.terminals)
            for k, (a, b) in enumerate(self.rules.tolist()):
                at, n = first[self.terminals + k], self.sizes[a]
                flat[at : at + n] = flat[first[a] : first[a] + n]
                flat[at + n : at + n + self.sizes[b]] = flat[first[b] : first[b] + self.sizes[b]]
            self._flat = flat
        return self._flat, first

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, first = self._expansions()
        return flat[ragged_range(first[symbols], self.sizes[symbols])]

    def lengths(self) -> np.ndarray:
        """Ids of each document."""
        total = np.concatenate([[0], np.cumsum(self.sizes[self.symbols])])
        return np.diff(total[self.starts])

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop of the document at this place, expanding only the symbols that hold them."""
        own = self.symbols[self.starts[doc] : self.starts[doc + 1]]
        ends = np.cumsum(self.sizes[own])
        stop = min(int(ends[-1]) if len(ends) else 0, np.inf if stop is None else stop)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(own[a:b])[start - before : stop - before]


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Writes shards under path and gives the table of them: part and shard (their order), data, n_docs, n_tokens."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a fixed vocabulary file of the driver's; workers get its text
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    parts = max(1, -(-docs.count() // partition_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(shared.value), TaskContext.get().partitionId()
        ids, lengths, docs_, null, size, shard = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, docs_, null, size, shard
            all_ids, n, own, none = (np.concatenate(x) for x in (ids, lengths, docs_, null))
            out = [[part], [shard], [pack(all_ids, n, own, none)], [len(own)], [len(all_ids)]]
            ids, lengths, docs_, null, size, shard = [], [], [], [], 0, shard + 1
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["part", "shard", "data", "n_docs", "n_tokens"])

        for batch in batches:
            texts = text_array(batch.column(1))
            for i, j in chunks(text_bytes(texts)[1], _CHUNK):
                found, n = encode(texts.slice(i, j - i).to_pylist())
                closed = np.full(len(found) + len(n), end_id, np.int32)
                closed[ragged_range((np.cumsum(n + 1) - n - 1), n)] = found
                column = batch.column(0).slice(i, j - i)
                ids.append(closed)
                lengths.append(n + 1)
                docs_.append(pc.fill_null(column, 0).to_numpy(zero_copy_only=False))
                null.append(column.is_null().to_numpy(zero_copy_only=False))
                size += len(closed)
                if size >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows.mapInArrow(run, _TABLE).write.parquet(path)
    return docs.sparkSession.read.schema(_TABLE).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of the shards: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(data)
                n = shard.lengths()
                end = np.cumsum(n)
                ids = shard.expand(shard.symbols).astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
                out = [pa.array(np.full(len(n), part)), pa.array(np.full(len(n), number, np.int32)), pa.array(shard.docs, mask=shard.null), pa.array(end - n), pa.array(n), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["part", "shard", "id", "within", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "shard", "data").mapInArrow(run, "part long, shard int, id long, within long, n_tokens long, ids_crc32 long")
    # prefix sums in two levels: over groups of range partitions, then within each group
    sizes = shards.select("part", "shard", "n_tokens", F.floor(F.col("part") / _GROUP).alias("group"))
    groups = sizes.groupBy("group").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("group", before.alias("group_start"))
    own = Window.partitionBy("group").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(groups, "group")
    starts = starts.select("part", "shard", (F.col("group_start") + F.col("own")).alias("shard_start"))
    return docs.join(starts, ["part", "shard"]).select("id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
