"""Spark helpers shared by the operators: shared storage, blocks of rows, hot buckets, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode only, a new one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandmill-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = _checkpoint_dir(spark) or folder
    return folder


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, as texts are long: bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def released(batches: Iterator) -> Iterator:
    """The batches; when they end, memory that the worker no longer uses goes back to the system, as workers live on."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20


def number_of_blocks(df: DataFrame, rows: int, text_col: str, size: int = BLOCK_BYTES) -> int:
    """Blocks of about `rows` rows, or of about `size` bytes of text where that gives more."""
    found = df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(text_col)).alias("size")).first()
    return max(1, -(-found.rows // rows), -(-(found.size or 0) // size))


def block_of(key: Column, blocks: int) -> Column:
    """A block by a hash of the key; rows without a key are dealt to all blocks by their place."""
    return F.pmod(F.xxhash64(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.monotonically_increasing_id())), F.lit(blocks)).cast("int")


#: Bytes of rows that a task packs at once.
PACKED_BYTES = 8 << 20


def packed_blocks(rows: DataFrame) -> DataFrame:
    """(block, data): the rows of each task that share a number `block`, together and compressed.

    What then moves to where a block's rows meet is a fraction of the texts; unpacked() gives the rows back.
    """
    columns = [c for c in rows.columns if c != "block"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.nbytes
            if held and (batch is None or size >= PACKED_BYTES):
                table = pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                number = table.column("block").to_numpy()
                order = np.argsort(number, kind="stable")
                table = table.select(columns).take(pa.array(order))
                at = np.concatenate([[0], np.flatnonzero(np.diff(number[order])) + 1, [len(order)]]).tolist() if len(order) else [0]
                data = [_packed(table.slice(a, b - a)) for a, b in itertools.pairwise(at)]
                yield pa.RecordBatch.from_arrays([pa.array(number[order][at[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["block", "data"])

    return rows.mapInArrow(lambda batches: released(pack(batches)), "block int, data binary")


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def unpacked(cells: pa.Table) -> pa.Table:
    """The rows of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in cells.column("data")]).combine_chunks()


def paired_blocks(df: DataFrame, bucket: str, member: Column, limit: int, weight: str | None = None) -> DataFrame:
    """Splits buckets of more than `limit` rows, or of more weight, for a comparison of all pairs in a bucket.

    Adds lo, hi and mine.  A bucket of up to `limit` stays whole (lo = hi = mine = 0).  A larger one
    is dealt into n parts by a hash of `member`, and each part meets each other in one (lo, hi) block, so a
    task holds about 2 * limit rows whatever the size of the bucket.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = df.groupBy(bucket).agg(size.alias("count")).where(F.col("count") > limit)
    if sizes.isEmpty():
        return df.withColumns({"lo": F.lit(0), "hi": F.lit(0), "mine": F.lit(0)})
    parts = F.coalesce(F.ceil(F.col("count") / limit).cast("int"), F.lit(1))
    dealt = joined(df, sizes, bucket, "left").withColumn("mine", F.pmod(F.xxhash64(member), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("other", "count")


#: Rows of a table that is broadcast: they are counted first.
BROADCAST_ROWS = 500_000
#: Rows of one key that a task joins.
HOT_ROWS = 200_000


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left (inner or left) joined with right, which has one row for each key, whatever share of left a key has.

    A right side of up to BROADCAST_ROWS rows (`rows`, or counted here) is broadcast.  Of a larger one, the row of each
    key that more than HOT_ROWS rows of left have is repeated and those are dealt among the copies; such keys are at
    most left's rows / HOT_ROWS.  Rows of left without a key are spread as well.
    """
    if (right.count() if rows is None else rows) <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("__copies")).where("__copies > 1")
    place = F.monotonically_increasing_id()
    dealt = F.when(F.col(key).isNull(), F.pmod(place, F.lit(1 << 12))).otherwise(F.pmod(place, F.coalesce("__copies", F.lit(1))))
    spread = left.join(F.broadcast(hot), key, "left").withColumn("__copy", dealt.cast("int")).drop("__copies")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))
    copied = right.join(F.broadcast(hot), key, "left").withColumn("__copy", every).drop("__copies")
    return spread.join(copied, [key, "__copy"], how).drop("__copy")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that links lead to.

    Alternates two local rewirings, each of which replaces a node's links by links to the smallest node
    nearby, until nothing changes; the number of rounds grows with the logarithm of the longest chain.
    Every round is checkpointed, so lost executors cost one round at most.  A node may have any share of the
    links.  Nodes without a link are not in the result; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    now, before = _measured(e), None
    while now != before:
        # nodes above a node move to the smallest beside it, which is itself where it has none below
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = joined(e, low.withColumnRenamed("u", "v"), "v", "left", rows=now[0])
        e = moved.select("u", F.coalesce("m", "v").alias("v")).distinct()
        # and so do the nodes below it
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(e, low, "u", rows=now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now, before = _measured(e), now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _measured(e: DataFrame) -> tuple:
    """Number and sum of hashes of the rows."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
