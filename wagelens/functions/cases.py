"""Case numbers: a prefix and an eleven-digit serial."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wagelens import fixed

DAY_DIGITS = 6


def well_formed(case_number: Column) -> Column:
    return F.coalesce(case_number.rlike(fixed.CASE_NUMBER_PATTERN), F.lit(False))


def _part(case_number: Column, start: int, length: int) -> Column:
    """A run of digits of a well-formed number; a malformed number gives null."""
    return F.when(case_number.rlike(fixed.CASE_NUMBER_PATTERN), F.substring(case_number, start, length))


def case_prefix(case_number: Column) -> Column:
    return _part(case_number, 3, 3).cast("int")


def case_serial(case_number: Column) -> Column:
    return F.concat(_part(case_number, 7, 5), _part(case_number, 13, 6)).cast("bigint")


def case_order(case_number: Column) -> Column:
    """A long that sorts as well-formed case numbers do; cheap to aggregate and shuffle."""
    digits = [F.substring(case_number, start, length) for start, length in ((3, 3), (7, 5), (13, 6))]
    return F.concat(*digits).try_cast("bigint")


def case_day(order: Column) -> Column:
    """The prefix and day of a `case_order`; a day's six-digit numbers allow a million cases."""
    return F.floor(order / F.lit(10**DAY_DIGITS)).cast("bigint")


def case_number(prefix: Column, serial: Column) -> Column:
    """Put the number together again, zero padding included."""
    scale = F.lit(10**DAY_DIGITS).cast("bigint")
    number = serial % scale
    day = ((serial - number) / scale).cast("bigint")
    return F.format_string("I-%03d-%05d-%06d", prefix, day, number)
