"""Tables between the rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; a new local one in local mode where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="strandmill-")


#: Bytes of a table that is broadcast.
BROADCAST_BYTES = 64 << 20


def few(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """df, marked to be broadcast if it has been counted to be small enough; a larger one is shuffled, and Spark splits hot keys."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() <= BROADCAST_BYTES // row_bytes else df


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder, in a directory for each value of `by` if it is given."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
