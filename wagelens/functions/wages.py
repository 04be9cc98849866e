"""Wage parsing, unit repair, annualization and outlier flags as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens import fixed

# A plain decimal number. The guard is needed because Spark's own cast also takes
# '1d', 'nan' and 'infinity'.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_wage(value: Column, dtype: T.DataType) -> Column:
    """A finite double; blank and NaN are null. What is no number, or no finite one, is null
    too, and `unreadable` finds it."""
    if isinstance(dtype, T.StringType):
        return _finite(F.when(value.rlike(_NUMBER), F.trim(value).try_cast("double")))
    return _finite(value.cast("double"))


def unreadable(value: Column, dtype: T.DataType) -> Column:
    """True where a non-blank cell holds something that is not a finite number."""
    if isinstance(dtype, T.StringType):
        return value.isNotNull() & to_wage(value, dtype).isNull()
    return F.coalesce(F.abs(value.cast("double")) == float("inf"), F.lit(False))


def unit_multiplier(unit: Column) -> Column:
    """Filed unit to factor, as a case expression: five fixed units need no join."""
    cases = F
    for name, times in fixed.UNIT_MULTIPLIERS.items():
        cases = cases.when(unit == name, F.lit(float(times)))
    return cases


def mislabelled(value: Column, unit: Column) -> Column:
    """Whether the unit must be wrong: scaled by it the wage is too high, as it stands it is not."""
    scaled_too_high = value * unit_multiplier(unit) > fixed.PLAUSIBLE_HI
    plausible_raw = value.between(fixed.PLAUSIBLE_LO, fixed.PLAUSIBLE_HI)
    return F.coalesce(scaled_too_high & plausible_raw, F.lit(False))


def repaired_multiplier(value: Column, unit: Column) -> Column:
    return F.when(mislabelled(value, unit), F.lit(1.0)).otherwise(unit_multiplier(unit))


def has_band(low: Column, high: Column) -> Column:
    return F.coalesce(high > low, F.lit(False))


def band_midpoint(low: Column, high: Column) -> Column:
    """The middle of a real band, otherwise the single filed figure."""
    return F.when(has_band(low, high), (low + high) / 2).otherwise(low)


def outside_band(wage: Column) -> Column:
    """True outside the reporting band and where there is no wage at all; never null."""
    return ~F.coalesce(wage.between(fixed.OUTLIER_LO, fixed.OUTLIER_HI), F.lit(False))


def whole_dollars(wage: Column) -> Column:
    """Round half to even, the rule the stored figures follow; 64 bits, so no wage is too wide."""
    return F.rint(wage).cast("bigint")
