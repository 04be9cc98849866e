"""Data-quality checks. Each is a DataFrame of violations or a row of counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that should be unique and are not."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Child keys without a parent, with the rows that carry them.

    Keys are counted before the anti join, so a frequent key is one row there.
    """
    used = (
        child.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return used.join(parent.select(key), key, "left_anti")


def orphan_report(child: DataFrame, parents: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """(table, orphan keys, orphan rows) for every reference; zeros where all is well."""
    parts = [
        orphans(child, key, parent).agg(
            F.lit(table).alias("lookup"),
            F.count(F.lit(1)).alias("n_keys"),
            F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"),
        )
        for table, (key, parent) in parents.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: nulls per column that must hold none."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def unknown_values(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Values outside a known set, nulls included, with their counts."""
    known_or_null = F.coalesce(F.col(column).isin(list(known)), F.lit(False))
    return df.filter(~known_or_null).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


# Copies of a row are written out in blocks, so that no array grows with their number.
_COPIES = 65_536


def differing_rows(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """Rows of one table the other lacks, doubles compared to ``digits`` places.

    Rows of the left count +1, of the right -1, and equal rows are summed up: one shuffle, with
    a partial sum before it. The sign of a sum tells the side, its size how often the row
    comes out.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")

    def signed(df: DataFrame, sign: int) -> DataFrame:
        fractional = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        return df.select(
            *[
                (F.round(F.col(c), digits) if c in fractional else F.col(c)).alias(c)
                for c in left.columns
            ],
            F.lit(sign).alias("__sign"),
        )

    both = signed(left, 1).unionByName(signed(right, -1))
    odd = both.groupBy(*left.columns).agg(F.sum("__sign").alias("__more")).filter(F.col("__more") != 0)
    copies = F.abs("__more") - 1
    blocks = odd.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor(copies / _COPIES).cast("bigint"))))
    in_block = F.least(F.lit(_COPIES), copies + 1 - F.col("__block") * _COPIES)
    return blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), in_block))).select(
        *left.columns, F.when(F.col("__more") > 0, F.lit("left")).otherwise(F.lit("right")).alias("side")
    )


def schema_differences(found: DataFrame | T.StructType, expected: T.StructType) -> list[str]:
    """Columns that are missing, unexpected or of another type."""
    schema = found.schema if isinstance(found, DataFrame) else found
    actual = {f.name: f.dataType for f in schema}
    wanted = {f.name: f.dataType for f in expected}
    differences = [f"missing {c}" for c in wanted if c not in actual]
    differences += [f"unexpected {c}" for c in actual if c not in wanted]
    differences += [
        f"{c} is {actual[c].simpleString()}, not {wanted[c].simpleString()}"
        for c in wanted
        if c in actual and actual[c] != wanted[c]
    ]
    return differences
