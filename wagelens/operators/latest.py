"""Keep the latest state of each key, and read the history of keys with several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wagelens.operators.positions import positions_within

ARROW = "→"


def latest_per_key(df: DataFrame, key: str, recency: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``recency``.

    The ``row_number() = 1`` form lets Catalyst put a WindowGroupLimit below the
    exchange, so every map task sends at most one row per key. A key holding a third
    of the table therefore shrinks to one row per task before it is shuffled.
    """
    newest_first = W.partitionBy(key).orderBy(*recency)
    return (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest_with_counts(df: DataFrame, key: str, newest: Column, n_name: str) -> DataFrame:
    """One row per key, the one with the greatest ``newest``, and how many rows the key had.

    An aggregate rather than a window: the count needs every row of a key, the row to keep is
    chosen along the way, and both are combined before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.max_by(F.struct(*others), newest).alias("_latest"), F.count(F.lit(1)).alias(n_name)
    )
    return grouped.select(key, *[F.col("_latest")[c].alias(c) for c in others], n_name)


def repeated_keys(df: DataFrame, key: str, n_name: str = "n_rows") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias(n_name)).filter(F.col(n_name) > 1)
    )


def rows_of_repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Every row whose key occurs more than once (a semi join, not a window per key)."""
    return df.join(repeated_keys(df, key).select(key), key, "left_semi")


def state_paths(
    df: DataFrame, key: str, state: str, order: Sequence[Column], path_name: str, n_name: str
) -> DataFrame:
    """How many keys went through which sequence of states, for keys seen more than once.

    The sequence follows ``order``. Neighbouring rows in one state are a run, written once
    with its length, ``Certified (x3)``; a state that comes back later is written again. The
    rows of a run are those whose rank inside the key and rank inside (key, state) differ by
    the same number. Both ranks come from range-partitioned sorts, so the rows of a very
    frequent key are spread; the list gathered per key grows with its changes of state.
    """
    ordered = {f"_by{i}": column for i, column in enumerate(order)}
    rows = rows_of_repeated_keys(df.select(key, state, *[c.alias(n) for n, c in ordered.items()]), key)
    # Nulls last: a row without a value to order by counts as the latest.
    by = [F.col(name).asc_nulls_last() for name in ordered]
    placed = positions_within(rows, [key], by, "_at").select(key, state, "_at")
    ranked = positions_within(placed, [key, state], [F.col("_at")], "_own")
    runs = ranked.groupBy(key, state, (F.col("_at") - F.col("_own")).alias("_run")).agg(
        F.min("_at").alias("_at"), F.count(F.lit(1)).alias("_n")
    )
    step = F.when(F.col("_n") == 1, F.col(state)).otherwise(
        F.concat(F.col(state), F.lit(" (x"), F.col("_n").cast("string"), F.lit(")"))
    )
    steps = F.array_sort(F.collect_list(F.struct("_at", step.alias("step"))))
    paths = runs.groupBy(key).agg(steps.alias("_steps")).select(
        F.array_join(F.col("_steps.step"), ARROW).alias(path_name)
    )
    return paths.groupBy(path_name).agg(F.count(F.lit(1)).alias(n_name))
