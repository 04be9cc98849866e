"""The top of a counted table, cut before anything is joined to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept_by_count(counted: DataFrame, count: str, k: int) -> DataFrame:
    """The rows whose count reaches the k-th highest one; ties at the cut are all kept.

    The threshold is one number, found by a partial top k in every task, so what breaks the
    ties (a name, say) needs to be joined to the rows above the cut only.
    """
    threshold = counted.select(F.col(count).alias("_least")).orderBy(F.col("_least").desc()).limit(k).agg(F.min("_least"))
    return counted.filter(F.col(count) >= threshold.scalar())
