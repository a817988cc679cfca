"""Shards by a keyed permutation of global row numbers: a reproducible shuffle in which the place of a row is computed.

Rows are numbered from 0 in order of id (rows without one first), rows of one id in order of a hash of all their
columns; rows equal in all of them are interchangeable, and a scan's row numbers only keep many such rows from meeting in one task.  A
Feistel network over an even number of bits, walked along its cycles until it is back below the number of rows, maps
row numbers to places: place p is slot p // shards of shard p % shards.  So shards differ by one row at most, slots have
no gaps, and both directions (`Permutation.forward`, `Permutation.backward`) need nothing but the number of rows and the seed.

Null texts have no bytes.  Null and repeated ids are rows like any other; no rows give no rows.  Only hashes and counts
by task reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._shared import written

SHARDS = 24
ROUNDS = 6
#: Bytes that a row takes in a shard besides its text.
ROW_BYTES = 8
#: Fixed values of the finishing step of a public 32-bit hash, by which a round mixes half of a number.
FIRST, SECOND = 0x85EBCA6B, 0xC2B2AE35
_LOW = (1 << 32) - 1
#: Bits of a row's place within a task, in Spark's increasing ids.
_PLACE = (1 << 33) - 1


class Permutation:
    """A keyed permutation of 0 to n - 1."""

    def __init__(self, n: int, seed: int | str = 0, rounds: int = ROUNDS):
        self.n = n
        #: Bits of half a number; both halves hold fewer than 4 n numbers (4 where n is 1), so a walk is short.
        self.half = max(1, -(-max(0, n - 1).bit_length() // 2))
        self.keys = [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:4], "little") for k in range(rounds)]

    def _mixed(self, half: np.ndarray, key: int) -> np.ndarray:
        h = half ^ np.uint64(key)
        h ^= h >> np.uint64(16)
        h = h * np.uint64(FIRST) & np.uint64(_LOW)
        h ^= h >> np.uint64(13)
        h = h * np.uint64(SECOND) & np.uint64(_LOW)
        return (h ^ h >> np.uint64(16)) & np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        if back:
            for key in reversed(self.keys):
                left, right = right ^ self._mixed(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._mixed(right, key)
        return left << bits | right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        out = self._network(np.asarray(numbers).astype(np.uint64), back)
        away = np.flatnonzero(out >= self.n)
        while len(away):
            out[away] = self._network(out[away], back)
            away = away[out[away] >= self.n]
        return out.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        """Places of row numbers."""
        return self._walk(numbers, False)

    def backward(self, places: np.ndarray) -> np.ndarray:
        """Row numbers at places."""
        return self._walk(places, True)


def shard_and_slot(numbers: np.ndarray, rows: int, shards: int = SHARDS, seed: int | str = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of these numbers are, of `rows` in all."""
    place = Permutation(rows, seed).forward(numbers)
    return place % shards, place // shards


def row_number(shard: np.ndarray, slot: np.ndarray, rows: int, shards: int = SHARDS, seed: int | str = 0) -> np.ndarray:
    """Which rows are there."""
    return Permutation(rows, seed).backward(np.asarray(slot) * shards + shard)


def numbered(rows: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """The rows with __number, from 0 without gaps in order of id, and how many they are.

    They are sorted by ranges and written to the shared folder, since what a task counted and what it returns must
    agree even if an executor is lost; rows that share an id are in as many ranges as their number asks for.
    """
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    order = [F.col(id_col), F.col("__hash"), F.col("__scan")]
    keyed = rows.withColumns({"__hash": F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), "__scan": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__hash", "__scan")
    table = written(dealt.withColumns({"__task": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}), "numbered")
    counts = sorted(table.groupBy("__task").count().collect())  # a row for each task that wrote
    ends = np.cumsum([c for _, c in counts], dtype=np.int64).tolist()
    firsts = [(task, end - count) for (task, count), end in zip(counts, ends, strict=True)]
    first = rows.sparkSession.createDataFrame(firsts, "__task int, __first long")
    out = table.join(F.broadcast(first), "__task").withColumn("__number", F.col("__first") + F.col("__place"))
    return out.drop("__task", "__place", "__first"), ends[-1] if ends else 0


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int | str = 0, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of docs (without texts unless with_text), and number, size, text_crc32, shard and slot in their place.

    size is the text's bytes in UTF-8 and ROW_BYTES more.  Of columns that docs has under these names, docs' are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = ("number", "size", "text_crc32", "shard", "slot")
    rows = docs.withColumns({"size": (F.octet_length(text) + ROW_BYTES).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    rows = rows.drop(*[c for c in ("number", "shard", "slot") if c not in (id_col, text_col)])
    ordered, n = numbered(rows if with_text else rows.drop(text_col), id_col)
    permutation = Permutation(n, seed)

    @F.pandas_udf("shard int, slot long")
    def place(numbers: pd.Series) -> pd.DataFrame:
        at = permutation.forward(numbers.to_numpy())
        return pd.DataFrame({"shard": (at % shards).astype(np.int32), "slot": at // shards})

    found = ordered.withColumnRenamed("__number", "number").withColumn("__at", place("number"))
    kept = [f"`{c}`" for c in ordered.columns if c not in (*own, "__number")]
    return found.select(*kept, "number", "size", "text_crc32", "__at.shard", "__at.slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int | str = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shuffled() as path/shard=k/, each in order of slot over as many files as ranges need, and reads it back."""
    rows = shuffled(docs, shards, seed, id_col, text_col)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
