"""Counts, shares, histograms and summaries of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.operators.positions import running_sums
from wagelens.operators.quantiles import ranked_quantiles


def histogram(df: DataFrame, value: str, width: int, floor_name: str, n_name: str) -> DataFrame:
    """Row counts per integer bin; a bin without rows is absent."""
    bin_floor = F.expr(f"(`{value}` div {int(width)}L) * {int(width)}L")
    return df.groupBy(bin_floor.alias(floor_name)).agg(F.count(F.lit(1)).alias(n_name))


def cumulative_cutoff(
    bins: DataFrame, floor_name: str, n_name: str, share: float
) -> DataFrame:
    """Where a histogram has shown ``share`` of its rows, and how many rows lie beyond."""
    summed = running_sums(bins, floor_name, n_name, "_upto")
    total = summed.agg(F.max("_upto")).scalar()
    before = F.col("_upto") - F.col(n_name)
    # A bin lies beyond the cut when the bins before it already reached the share.
    beyond = (before > 0) & (before / total >= share)
    return summed.agg(
        F.max(F.when(~beyond, F.col(floor_name))).alias("cap"),
        F.coalesce(F.sum(F.when(beyond, F.col(n_name))), F.lit(0)).alias("beyond"),
    ).filter(F.col("cap").isNotNull())


def value_shares(
    df: DataFrame, column: str, n_name: str, share_name: str, digits: int = 6
) -> DataFrame:
    """Counts per value, nulls included, with each value's share of all rows.

    The total is a scalar subquery over the counts, so no row passes a global window.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(n_name))
    total = counts.agg(F.sum(n_name)).scalar()
    share = F.round(F.col(n_name).cast("double") / total.cast("double"), digits)
    return counts.withColumn(share_name, share)


def distinct_before_after(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """How many distinct values a normalization leaves."""
    pairs = df.groupBy(before.alias("_raw"), after.alias("_normal")).agg(F.lit(1).alias("_one"))
    return pairs.agg(
        F.count_distinct("_raw").alias("n_raw"),
        F.count_distinct("_normal").alias("n_normalized"),
    ).withColumn("n_collapsed", F.col("n_raw") - F.col("n_normalized"))


def numeric_summary(
    df: DataFrame, value: str, fractions: Mapping[str, float]
) -> DataFrame:
    """Count, mean, spread, extremes and exact quantiles of one column: one row."""
    moments = df.agg(
        F.count(value).alias("n"),
        F.mean(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    return with_single_row(moments, ranked_quantiles(df, [], value, fractions, "_rows").drop("_rows"))


def with_single_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row frame, by a scalar subquery instead of a cross join."""
    packed = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", packed).select(*df.columns, *[f"_row.{c}" for c in row.columns])


def largest(df: DataFrame, by: str, k: int, tie_break: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest value, ties settled by the given columns."""
    return df.orderBy(F.col(by).desc_nulls_last(), *tie_break).limit(k)


def unpivot_counts(row: DataFrame, label: str, n_name: str) -> DataFrame:
    """A one-row table of counts as (label, count) rows."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias(label), F.col(f"`{c}`").cast("bigint").alias(n_name))
                for c in row.columns
            ]
        )
    )
    return row.select(pairs.alias("_pair")).select(f"_pair.{label}", f"_pair.{n_name}")
