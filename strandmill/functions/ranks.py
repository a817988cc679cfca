"""Order over all rows without one task that holds them: ranges of values, then each range by itself."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.storage import written

#: Rows of a range, about.
RANGE_ROWS = 100_000


def with_before(rows: DataFrame, column: str, weight: str) -> DataFrame:
    """Adds before: the sum of weight, whole numbers, over the rows with a smaller value of column, which is no row's twice.

    There are as many ranges as rows ask for; they are written, so that all that is read of them agrees, and a row for
    each reaches the driver.
    """
    parts = -(-rows.count() // RANGE_ROWS)
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if parts <= 1:
        return rows.withColumn("__range", F.lit(0)).withColumn("before", own.cast("long")).drop("__range")
    placed = written(rows.repartitionByRange(parts, column).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted(placed.groupBy("__range").agg(F.sum(weight).cast("long").alias("size")).collect())
    firsts = list(zip([k for k, _ in sizes], accumulate((n or 0 for _, n in sizes), initial=0)))
    starts = rows.sparkSession.createDataFrame(firsts, "__range int, __start long")
    return placed.join(F.broadcast(starts), "__range").withColumn("before", (F.col("__start") + own).cast("long")).drop("__range", "__start")


def values_at(ordered: DataFrame, column: str, weight: str, places: list[float]) -> list[float]:
    """The values at places from 0 in order, interpolated between neighbours; ordered has column, weight and before."""
    wanted = sorted({k for p in places for k in (int(p), int(p) + (p > int(p)))})
    if not wanted:
        return []
    holds = F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col(weight)))
    found = {k: float(r.v) for r in ordered.select(F.col(column).alias("v"), holds.alias("k")).where(F.size("k") > 0).collect() for k in r.k}  # a row a place at most
    return [found[int(p)] + (found[int(p) + (p > int(p))] - found[int(p)]) * (p - int(p)) for p in places]


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """Adds position: places from 0 in an order that ties by no two rows.

    Rows are sorted by ranges and written, so that what a task counted and what it returns agree; a row for each task
    reaches the driver.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within a task
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(ranges.withColumns({"__task": F.spark_partition_id(), "__place": place}), "ordered")
    counts = sorted(table.groupBy("__task").count().collect())
    firsts = list(zip([task for task, _ in counts], accumulate((n for _, n in counts), initial=0)))
    first = rows.sparkSession.createDataFrame(firsts, "__task int, __first long")
    return table.join(F.broadcast(first), "__task").withColumn("position", F.col("__first") + F.col("__place")).drop("__task", "__first", "__place")
