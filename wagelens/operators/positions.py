"""Row positions in a total order, without a window over the whole table.

``row_number()`` over everything, or over one very large group, runs in a single task.
Here the rows are range-partitioned and sorted once, numbered inside each partition, and
written; the partition sizes then give every partition its offset. The written table is
what both steps read, so a lost executor cannot renumber anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wagelens.session import staging_path

# monotonically_increasing_id(): partition number above this bit, row number below.
_ROW_BITS = 33


def global_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with a dense 0-based position under ``order``, which must be total."""
    spark = df.sparkSession
    path = staging_path(spark, "positions")
    (
        df.orderBy(*order)
        .withColumn("__slot", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    slots = spark.read.parquet(path).withColumn(
        "__part", F.shiftright("__slot", _ROW_BITS)
    )
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # One row per write task: at most spark.sql.shuffle.partitions rows.
    offsets = (
        slots.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__size"))
        .select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    )
    row = F.col("__slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        slots.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + row)
        .drop("__slot", "__part", "__offset")
    )


def running_sums(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row under ``order``.

    As above: one sort, sums inside each sorted part, and the parts' sums as offsets, so
    that no window runs over everything. ``order`` must be total.
    """
    spark = df.sparkSession
    path = staging_path(spark, "sums")
    df.orderBy(order).withColumn("__slot", F.monotonically_increasing_id()).write.parquet(path)
    slots = spark.read.parquet(path).withColumn("__part", F.shiftright("__slot", _ROW_BITS))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # One row per write task.
    offsets = slots.groupBy("__part").agg(F.sum(value).alias("__size")).select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    inside = W.partitionBy("__part").orderBy("__slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        slots.withColumn("__sum", F.sum(value).over(inside)).join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + F.col("__sum"))
        .drop("__slot", "__part", "__offset", "__sum")
    )


def positions_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """``df`` with a 1-based rank inside each key: ``row_number()`` for groups of any size.

    One global order over (keys, order) splits a large group over many partitions; the
    rank is the distance to the group's first position.
    """
    placed = global_positions(df, [*[F.col(k) for k in keys], *order], "__position")
    if not keys:
        return placed.withColumn(name, F.col("__position") + 1).drop("__position")
    starts = placed.groupBy(*[F.col(k).alias(k + "__s") for k in keys]).agg(
        F.min("__position").alias("__start")
    )
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(k + "__s")) for k in keys])
    return (
        placed.join(starts, match)
        .withColumn(name, F.col("__position") - F.col("__start") + 1)
        .drop("__position", "__start", *[k + "__s" for k in keys])
    )


def bucketed_positions(
    df: DataFrame, bucket: str, order: Sequence[Column], name: str
) -> DataFrame:
    """``df`` with a dense 0-based position, where a column already cuts the order in ranges.

    ``bucket`` must rise with ``order`` and hold a bounded number of rows. Each bucket is
    ranked by itself and the bucket counts give the offsets, so nothing is staged and the
    only window over everything sees one row per bucket.
    """
    own = W.partitionBy(bucket).orderBy(*order)
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(F.col(bucket).alias("__bucket"))
        .agg(F.count(F.lit(1)).alias("__size"))
        .select("__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        df.withColumn("__row", F.row_number().over(own) - 1)
        .join(offsets, F.col(bucket).eqNullSafe(F.col("__bucket")))
        .withColumn(name, F.col("__offset") + F.col("__row"))
        .drop("__row", "__bucket", "__offset")
    )
