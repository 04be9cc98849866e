"""Constraints stated as data, and what breaks them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.operators.checks import duplicate_keys, orphans

NOT_NULL, UNIQUE, REFERENCE = "not null", "unique", "reference"


@dataclass(frozen=True)
class Constraint:
    """One rule about a table: its columns hold no null, or no value twice, or only values that
    the column of the same name in ``parent`` has."""

    kind: str
    table: str
    columns: tuple[str, ...]
    parent: str | None = None


def not_null(table: str, columns: Sequence[str]) -> list[Constraint]:
    return [Constraint(NOT_NULL, table, (c,)) for c in columns]


def _row(rule: Constraint, n_keys: Column, n_rows: Column) -> list[Column]:
    return [
        F.lit(rule.kind).alias("rule"), F.lit(rule.table).alias("table"), F.lit(",".join(rule.columns)).alias("columns"),
        n_keys.cast("bigint").alias("n_keys"), n_rows.cast("bigint").alias("n_rows"),
    ]


def _nulls(df: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """All not-null rules of a table from one pass over it."""
    counts = df.agg(*[F.count_if(F.col(r.columns[0]).isNull()).alias(r.columns[0]) for r in rules])
    one_by_one = F.explode(F.array(*[
        F.struct(*_row(r, F.least(F.col(r.columns[0]), F.lit(1)), F.col(r.columns[0]))) for r in rules
    ]))
    return counts.select(one_by_one.alias("_r")).select("_r.*")


def _broken_keys(broken: DataFrame, rule: Constraint) -> DataFrame:
    return broken.agg(F.count(F.lit(1)).alias("_k"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("_n")).select(
        *_row(rule, F.col("_k"), F.col("_n"))
    )


def broken_constraints(tables: Mapping[str, DataFrame], rules: Sequence[Constraint]) -> DataFrame:
    """(rule, table, columns, n_keys, n_rows): one row per rule, zeros where it holds.

    ``n_keys`` are the values that break a rule (1 for null), ``n_rows`` the rows that hold them. Null
    keys are left to the not-null rules where a reference is checked, and count as a value where
    uniqueness is. Keys are counted before anything is joined, so a frequent one is one row.
    """
    parts = []
    for table in dict.fromkeys(r.table for r in rules if r.kind == NOT_NULL):
        parts.append(_nulls(tables[table], [r for r in rules if r.kind == NOT_NULL and r.table == table]))
    for rule in rules:
        if rule.kind == UNIQUE:
            parts.append(_broken_keys(duplicate_keys(tables[rule.table], rule.columns), rule))
        elif rule.kind == REFERENCE:
            (column,) = rule.columns
            parents = tables[rule.parent].select(column).distinct()
            parts.append(_broken_keys(orphans(tables[rule.table], column, parents), rule))
    return reduce(DataFrame.unionByName, parts)
