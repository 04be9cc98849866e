"""Exact interpolated quantiles that do not gather a group's rows in one task.

Equal values are counted first, ``groupBy(keys, value).count()``. The count combines on
the map side and shuffles on key *and* value, so a key that holds a third of the rows
spreads over all reducers. What remains per key is its distinct values.

* ``grouped_quantiles`` hands the counts to the built-in ``percentile`` as frequencies.
  Its state per key is the key's distinct values: right where the value domain is
  bounded, such as whole-dollar wages inside the reporting band (under two million).
* ``ranked_quantiles`` makes no assumption about the domain. It finds the ranks wanted
  among cells that rise with the value, from a fixed grid or from a rank sketch, and sorts
  values only inside the cells that hold them.

Both interpolate at position ``fraction * (n - 1)`` and give the same figures.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.session import staged

# Grid cells per doubling of the magnitude: each is about 1.1 % wide, and all doubles
# together fill at most 2 * 64 * 2200 of them.
_CELLS_PER_DOUBLING = 64
_LOWEST_EXPONENT = 1100

# Integers of 64 bits are cut at the ends of a bracket around every wanted rank, taken from a
# rank sketch. A sketch of size k misplaces a rank by about 2.3 / k^0.9 (published for the 99 %
# level); brackets are twice as wide on either side. Without keys the sketch is larger.
_SKETCH, _SKETCH_ALONE = 512, 4096
_BRACKET = 2 * 2.296
_SKETCH_POWER = 0.9021

# A 1.1 % cell holds at most 24 million integers of 32 bits and 2^46 doubles. Two cuts
# into 2^16 linear parts leave at most 2^15 doubles.
_SMALL_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)
_LINEAR_CELLS = 65_536
_CUTS = 2


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, _n) for the non-null values."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    n_name: str,
) -> DataFrame:
    """Quantiles per key over a value domain of bounded size; no keys gives one row."""
    wanted = F.array(*[F.lit(float(f)) for f in fractions.values()])
    grouped = value_counts(df, keys, value).groupBy(*keys).agg(
        F.percentile(F.col(value), wanted, F.col("_n")).alias("_q"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias(n_name),
    )
    picked = [F.col("_q")[i].alias(name) for i, name in enumerate(fractions)]
    return grouped.select(*keys, *picked, n_name)


def _magnitude_cell(value: Column) -> Column:
    """The grid cell of a number; rises with the number, zero has its own."""
    v = value.cast("double")
    steps = F.floor((F.log2(F.abs(v)) + _LOWEST_EXPONENT) * _CELLS_PER_DOUBLING)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * steps).cast("bigint")


def _linear_cell(value: Column) -> Column:
    """The part of its cell's value range a number lies in."""
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    part = F.floor(F.try_divide(value.cast("double") - low, high - low) * _LINEAR_CELLS)
    return F.coalesce(part, F.lit(0)).cast("bigint")


def _splitters(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float], size: int
) -> DataFrame:
    """(keys, _cuts): per key, values that bracket each wanted rank, from one pass over the rows."""
    width = _BRACKET / size**_SKETCH_POWER
    ranks = sorted({min(max(f + side, 0.0), 1.0) for f in fractions.values() for side in (-width, width)})
    seen = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.kll_sketch_agg_bigint(value, size).alias("_sketch"), F.count(F.lit(1)).alias("_rows")
    )
    wanted = F.array(*[F.lit(float(r)) for r in ranks])
    # An empty sketch has no quantiles.
    cuts = F.when(F.col("_rows") > 0, F.kll_sketch_get_quantile_bigint("_sketch", wanted))
    return seen.select(*keys, cuts.alias("_cuts"))


def _bracketed(
    counts: DataFrame, df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]
) -> DataFrame:
    """``counts`` with the cell each value lies in, between its key's splitters.

    Cells rise with the value and hold every value, whatever the sketch says: where it errs, a
    larger cell is sorted and the result is the same.
    """
    cuts = _splitters(df, keys, value, fractions, _SKETCH if keys else _SKETCH_ALONE)
    n_cuts = 2 * len(fractions)
    ends = [F.get(F.col("_cuts"), F.lit(i)) for i in range(n_cuts)]
    # A low end starts a cell, a high end still belongs to its own; null ends count for nothing.
    beyond = [F.coalesce((F.col(value) >= e).cast("int") + (F.col(value) > e).cast("int"), F.lit(0)) for e in ends]
    cell = reduce(Column.__add__, beyond).cast("bigint")
    by = {f"{k}__c": k for k in keys} or {"_all__c": None}
    renamed = cuts.select(*[(F.col(k) if k else F.lit(0)).alias(name) for name, k in by.items()], "_cuts")
    left = counts if keys else counts.withColumn("_all", F.lit(0))
    match = reduce(and_, [F.col(name.removesuffix("__c")).eqNullSafe(F.col(name)) for name in by])
    return left.join(renamed, match).withColumn("_cell", cell).drop("_cuts", *by, *([] if keys else ["_all"]))


def _spots(fractions: Mapping[str, float]) -> list[Column]:
    """The wanted positions among ``_total`` values, counted from 0."""
    return [F.lit(float(f)) * (F.col("_total") - 1) for f in fractions.values()]


def _narrow(
    counts: DataFrame, parents: Sequence[str], value: str, fractions: Mapping[str, float]
) -> DataFrame:
    """Only the cells of each parent that hold a wanted rank.

    ``counts`` has (parents, value, _n, _cell). Added are the rank ``_base`` at which a
    cell starts, the key's ``_total`` and the cell's value range. The windows see one row
    per cell, and a parent has a bounded number of cells.
    """
    inner = "_base" in parents
    parent = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    running = parent.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = counts.groupBy(*parents, "_cell").agg(
        F.sum("_n").alias("_size"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
        *([F.max("_total").alias("_total")] if inner else []),
    )
    if not inner:
        sizes = sizes.withColumn("_total", F.sum("_size").over(parent))
    before = F.col("_base") if inner else F.lit(0)
    cells = sizes.withColumn("_end", before + F.sum("_size").over(running)).withColumn(
        "_begin", F.col("_end") - F.col("_size")
    )
    ranks = [rank(spot) for spot in _spots(fractions) for rank in (F.floor, F.ceil)]
    holds = reduce(or_, [(r >= F.col("_begin")) & (r < F.col("_end")) for r in ranks])
    match = [*parents, "_cell"]
    wanted = cells.filter(holds).select(
        *[F.col(c).alias(f"{c}__w") for c in match],
        F.col("_begin").alias("_base__n"),
        F.col("_total").alias("_total__n"),
        "_low",
        "_high",
    )
    # Null-safe throughout: a plain equality adds a not-null filter to one branch, and
    # the value counts would no longer be one exchange that both branches reuse.
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}__w")) for c in match])
    keys = [c for c in parents if c != "_base"]
    return counts.join(wanted, same).select(
        *keys,
        value,
        "_n",
        F.col("_base__n").alias("_base"),
        F.col("_total__n").alias("_total"),
        "_low",
        "_high",
    )


def ranked_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    n_name: str,
) -> DataFrame:
    """Quantiles per key over any finite numbers, by rank; no keys gives one row.

    Integers repeat, so counting equal values first shrinks them. Those of 64 bits are then cut
    at brackets from a rank sketch, so what the last sort sees is a small share of a key's
    different values (0.4 % per fraction without keys, 3 % with). Fractions may all differ;
    their cells are counted row by row, which combines on the map side, and only the rows of
    the wanted cells are shuffled. ``df`` is read twice: pass a stored table, not a long plan.
    """
    cell = _magnitude_cell(F.col(value))
    if isinstance(df.schema[value].dataType, _SMALL_INTEGERS):
        counts = value_counts(df, keys, value).withColumn("_cell", cell)
        placed = _narrow(counts, keys, value, fractions)
    elif isinstance(df.schema[value].dataType, T.LongType):
        counts = _bracketed(value_counts(df, keys, value), df, keys, value, fractions)
        placed = _narrow(counts, keys, value, fractions)
    else:
        rows = df.select(*keys, value).filter(F.col(value).isNotNull()).withColumn("_n", F.lit(1).cast("bigint"))
        rows = rows.withColumn("_cell", cell)
        placed = (
            _narrow(rows, keys, value, fractions)
            .groupBy(*keys, value, "_base", "_total", "_low", "_high")
            .agg(F.sum("_n").alias("_n"))
        )
        for _ in range(_CUTS):
            # The cells that matter are a small part of the values; they are written so
            # that the next cut reads them instead of finding them again.
            placed = staged(placed, "cells")
            finer = placed.withColumn("_cell", _linear_cell(F.col(value))).drop("_low", "_high")
            placed = _narrow(finer, [*keys, "_base"], value, fractions)

    within = (
        W.partitionBy(*keys, "_base")
        .orderBy(value)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = placed.withColumn("_end", F.col("_base") + F.sum("_n").over(within)).withColumn(
        "_start", F.col("_end") - F.col("_n")
    )

    def value_at(rank: Column) -> Column:
        holds = (rank >= F.col("_start")) & (rank < F.col("_end"))
        return F.max(F.when(holds, F.col(value).cast("double")))

    ends = []
    for i, spot in enumerate(_spots(fractions)):
        ends += [
            value_at(F.floor(spot)).alias(f"_lo{i}"),
            value_at(F.ceil(spot)).alias(f"_hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"_part{i}"),
        ]
    grouped = ranked.groupBy(*keys).agg(
        F.coalesce(F.max("_total"), F.lit(0)).cast("bigint").alias(n_name), *ends
    )
    interpolated = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(name)
        for i, name in enumerate(fractions)
    ]
    return grouped.select(*keys, *interpolated, n_name)


def quantile_over(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]
) -> DataFrame:
    """Each row with its group's quantiles, as a window function would attach them.

    A window would sort a whole group in one task. Here the group is reduced first and
    its one result row is joined back.
    """
    return _attach(df, ranked_quantiles(df, keys, value, fractions, "_n_rows").drop("_n_rows"), keys)


def count_over(df: DataFrame, keys: Sequence[str], n_name: str) -> DataFrame:
    """Each row with its group's row count, from a reduced side instead of a window."""
    return _attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_name)), keys)


def _attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    extra = [c for c in per_key.columns if c not in keys]
    renamed = per_key.select(*[F.col(k).alias(k + "__g") for k in keys], *extra)
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(k + "__g")) for k in keys])
    return df.join(renamed, match, "left").drop(*[k + "__g" for k in keys])
