"""Lenient dates and the federal fiscal year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lenient_date(value: Column, dtype: T.DataType) -> Column:
    """A date; what cannot be read is null rather than an error."""
    if isinstance(dtype, T.DateType):
        return value
    if isinstance(dtype, T.StringType):
        us_style = F.try_to_timestamp(value, F.lit("M/d/yyyy")).cast("date")
        return F.coalesce(value.try_cast("date"), us_style)
    return value.try_cast("date")


def fiscal_year_of(date: Column) -> Column:
    """October opens the next year."""
    return F.year(date) + (F.month(date) >= 10).cast("int")


def fiscal_year(decided: Column, received: Column, earliest: int) -> Column:
    """Year of the decision, or the received year raised to the earliest covered one.

    ``greatest`` skips nulls, so a filing without any date is kept null by the guard.
    """
    spare = F.when(received.isNotNull(), F.greatest(fiscal_year_of(received), F.lit(earliest)))
    return F.coalesce(fiscal_year_of(decided), spare).cast("int")
