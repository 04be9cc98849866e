"""Joins in which a few keys hold many rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The smallest share that the frequent-items pass looks for.
_LEAST_SHARE = 1e-4


def frequent_values(df: DataFrame, columns: Mapping[str, Column], share: float) -> dict[str, list]:
    """Per name the values that hold more than ``share`` of the rows, from one pass over all of them.

    At most 1 / share values each come back, none that is frequent is left out, and some that
    are not may be among them. Null is not told.
    """
    names = list(columns)
    found = df.select(*[columns[n].alias(n) for n in names]).stat.freqItems(names, max(share, _LEAST_SHARE)).first()
    return {n: [v for v in found[f"{n}_freqItems"] or [] if v is not None] for n in names}


def key_text(columns: Sequence[Column]) -> Column:
    """A key of text columns as one text."""
    return columns[0] if len(columns) == 1 else F.concat_ws("\0", *columns)


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], frequent: Sequence, spread: Column, parts: int
) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row per key; null keys meet.

    Rows of a frequent key are dealt by ``spread`` over ``parts`` copies of its one row in ``right``, so no task
    gets them all, whatever the join. Other keys are joined as they are.
    """
    ours, theirs = [F.col(k) for k in keys], [F.col(f"{k}__r") for k in keys]
    renamed = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    same = reduce(and_, [a.eqNullSafe(b) for a, b in zip(ours, theirs)])
    if not frequent:
        return left.join(renamed, same, "left").drop(*[f"{k}__r" for k in keys])
    hot = list(frequent)
    dealt = F.when(key_text(ours).isin(hot), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(key_text(theirs).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    joined = left.withColumn("_part", dealt).join(
        renamed.withColumn("_part__r", F.explode(copies)), same & (F.col("_part") == F.col("_part__r")), "left"
    )
    return joined.drop("_part", "_part__r", *[f"{k}__r" for k in keys])
