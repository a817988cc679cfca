"""Results kept as Parquet under a hash of what they were made from: names, arguments and the rows of the inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.storage import shared_folder  # noqa: F401


def content(df: DataFrame) -> str:
    """Number and sum of hashes of the rows, whatever their order, and the columns."""
    columns = sorted(df.columns)
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)"))).first()
    return f"{columns} {n} {total}"


#: What results were made by: raised when the same inputs come to give others.
VERSION = 3


def key(name: str, *inputs: DataFrame, **arguments) -> str:
    """Changed rows, arguments or version give another key."""
    made_from = [VERSION, arguments, [content(df) for df in inputs]]
    return f"{name}/{hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def cached(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], *inputs: DataFrame, **arguments) -> DataFrame:
    """make(), or what it gave before for the same name, inputs and arguments.  Spark writes _SUCCESS last, which marks it whole."""
    path = f"{folder}/{key(name, *inputs, **arguments)}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_by_family(spark: SparkSession, folder: str, name: str, inputs: DataFrame, make: Callable[[DataFrame], DataFrame], **arguments) -> DataFrame:
    """make(inputs) by family: only families not done before, or whose rows have changed, are made, and added."""
    path = f"{folder}/{key(name, **arguments)}"
    columns = [F.col(f"`{c}`") for c in sorted(inputs.columns)]
    versions = inputs.groupBy("family").agg(F.concat_ws("-", F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).alias("version"))
    if _exists(spark, path):
        done = spark.read.parquet(path).select("family", "version").distinct()
        versions_left = versions.join(done, ["family", "version"], "left_anti")
    else:
        versions_left = versions
    todo = inputs.join(versions_left.select("family"), "family", "left_semi")
    make(todo).join(versions, "family").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(versions, ["family", "version"]).drop("version")
