"""Raw filings to cleaned filings.

The order carries meaning: latest state per case, then committed statuses, then unit
repair, annualization, band midpoint and only then the outlier flags.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens import fixed
from wagelens.functions import dates, text, wages
from wagelens.functions.cases import well_formed
from wagelens.operators.latest import latest_per_key, latest_with_counts
from wagelens.sources.filings import POSITION
from wagelens.sources.sinks import remove, replace


class BadFilings(ValueError):
    """The filings break a rule that the plan cannot repair."""


_PAIRS = {
    # measured column -> unit column
    "WAGE_RATE_OF_PAY_FROM": "WAGE_UNIT_OF_PAY",
    "PREVAILING_WAGE": "PW_UNIT_OF_PAY",
}
_WAGE_COLUMNS = ("WAGE_RATE_OF_PAY_FROM", "WAGE_RATE_OF_PAY_TO", "PREVAILING_WAGE")


def latest_filings(raw: DataFrame, position: str = POSITION) -> DataFrame:
    """One row per case. A missing decision date counts as the latest; ties go to the later row."""
    recency = [_date(raw, "DECISION_DATE").desc_nulls_first()]
    if position in raw.columns:
        recency.append(F.col(position).desc())
    return latest_per_key(raw, "CASE_NUMBER", recency)


FILED = "_filed"


def counted_latest(raw: DataFrame, position: str = POSITION) -> DataFrame:
    """``latest_filings`` with ``_filed``, the number of rows of each case: what a build stages, so
    that the ledger and the cleaned table come from one reading of the sources."""
    decided = _date(raw, "DECISION_DATE")
    later = [F.col(position)] if position in raw.columns else []
    return latest_with_counts(raw, "CASE_NUMBER", F.struct(decided.isNull(), decided, *later), FILED)


def certified(latest: DataFrame) -> DataFrame:
    """Filings an employer committed to; a missing status is none of these."""
    return latest.filter(F.col("CASE_STATUS").isin(*fixed.KEEP_STATUSES))


def of_visa_class(df: DataFrame, visa_class: str = "H-1B") -> DataFrame:
    return df.filter(F.col("VISA_CLASS") == visa_class)


def _wage(df: DataFrame, column: str) -> Column:
    return wages.to_wage(F.col(column), df.schema[column].dataType)


def _date(df: DataFrame, column: str) -> Column:
    return dates.lenient_date(F.col(column), df.schema[column].dataType)


def annualized(df: DataFrame) -> DataFrame:
    """Adds the repaired band, its midpoint and the prevailing wage, with their flags.

    The repair is decided once, from the low end, and applied to both ends.
    """
    unit, pw_unit = F.col("WAGE_UNIT_OF_PAY"), F.col("PW_UNIT_OF_PAY")
    parsed = df.withColumns(
        {
            "_low": _wage(df, "WAGE_RATE_OF_PAY_FROM"),
            "_high": _wage(df, "WAGE_RATE_OF_PAY_TO"),
            "_pw": _wage(df, "PREVAILING_WAGE"),
        }
    )
    low, high, pw = F.col("_low"), F.col("_high"), F.col("_pw")
    factor = wages.repaired_multiplier(low, unit)
    scaled = parsed.withColumns(
        {
            "annual_from": low * factor,
            "annual_to": high * factor,
            "unit_repaired": wages.mislabelled(low, unit),
            "prevailing_wage_annual": pw * wages.repaired_multiplier(pw, pw_unit),
            "pw_repaired": wages.mislabelled(pw, pw_unit),
        }
    ).drop("_low", "_high", "_pw")
    return scaled.withColumn(
        "annual_wage", wages.band_midpoint(F.col("annual_from"), F.col("annual_to"))
    )


def cleaned_layout(kept: DataFrame, earliest_year: int = fixed.EARLIEST_FISCAL_YEAR) -> DataFrame:
    """The 21 cleaned columns of certified filings."""
    df = annualized(kept)
    decided, received = _date(df, "DECISION_DATE"), _date(df, "RECEIVED_DATE")
    return df.select(
        F.col("CASE_NUMBER").alias("case_number"),
        F.col("CASE_STATUS").alias("case_status"),
        F.col("VISA_CLASS").alias("visa_class"),
        decided.alias("decision_date"),
        dates.fiscal_year(decided, received, earliest_year).alias("fiscal_year"),
        text.normalize_employer(F.col("EMPLOYER_NAME")).alias("employer_name"),
        F.col("EMPLOYER_NAME").alias("employer_raw"),
        text.unescape(F.col("JOB_TITLE")).alias("job_title"),
        text.normalize_soc(F.col("SOC_CODE")).alias("soc_code"),
        text.unescape(F.col("SOC_TITLE")).alias("soc_title"),
        text.normalize_city(F.col("WORKSITE_CITY")).alias("worksite_city"),
        text.normalize_state(F.col("WORKSITE_STATE")).alias("worksite_state"),
        "annual_from",
        "annual_to",
        "annual_wage",
        F.col("prevailing_wage_annual").alias("prevailing_wage"),
        F.coalesce(F.col("FULL_TIME_POSITION") == "Y", F.lit(False)).alias("full_time"),
        "unit_repaired",
        wages.outside_band(F.col("annual_wage")).alias("is_outlier"),
        "pw_repaired",
        wages.outside_band(F.col("prevailing_wage_annual")).alias("pw_outlier"),
    )


def clean(
    raw: DataFrame,
    tech_only: bool = True,
    earliest_year: int = fixed.EARLIEST_FISCAL_YEAR,
) -> DataFrame:
    """The lazy plan. ``write_cleaned`` and ``require_valid`` also enforce the rules."""
    out = cleaned_layout(certified(latest_filings(raw)), earliest_year)
    return out.filter(text.is_tech(F.col("soc_code"))) if tech_only else out


# ---- rules that must hold ------------------------------------------------------


def violation_counts(df: DataFrame, earliest_year: int) -> list[Column]:
    """One count per rule, all from the same pass over the certified filings."""
    rules: dict[str, Column] = {}
    for column in _WAGE_COLUMNS:
        rules[f"{column} not numbers"] = wages.unreadable(F.col(column), df.schema[column].dataType)
    for unit in _PAIRS.values():
        rules[f"{unit} unmapped"] = wages.unit_multiplier(F.col(unit)).isNull()
    rules["high end but no _FROM"] = (
        F.col("WAGE_RATE_OF_PAY_FROM").isNull() & F.col("WAGE_RATE_OF_PAY_TO").isNotNull()
    )
    decided = dates.fiscal_year_of(_date(df, "DECISION_DATE"))
    rules[f"decided before FY{earliest_year}"] = decided < earliest_year
    rules["without any date"] = (
        _date(df, "DECISION_DATE").isNull() & _date(df, "RECEIVED_DATE").isNull()
    )
    rules["case number malformed"] = ~well_formed(F.col("CASE_NUMBER"))
    return [F.count_if(rule).alias(name) for name, rule in rules.items()]


def violations(kept: DataFrame, earliest_year: int = fixed.EARLIEST_FISCAL_YEAR) -> DataFrame:
    """One row: how many certified filings break each rule."""
    return kept.agg(*violation_counts(kept, earliest_year))


def _refuse(counts: dict[str, int], kept: DataFrame) -> None:
    broken = {rule: n for rule, n in counts.items() if n}
    if not broken:
        return
    parts = []
    for rule, n in broken.items():
        parts.append(f"{rule}: {n:,} filings{_samples(rule, kept)}")
    raise BadFilings("; ".join(parts))


def _samples(rule: str, kept: DataFrame) -> str:
    """Up to five offending values, read only once something is known to be wrong."""
    column = rule.split(" ")[0]
    if column not in kept.columns:
        return ""
    dtype: T.DataType = kept.schema[column].dataType
    if column in _WAGE_COLUMNS:
        wrong = wages.unreadable(F.col(column), dtype)
    else:
        wrong = wages.unit_multiplier(F.col(column)).isNull()
    found = kept.filter(wrong).select(column).distinct().orderBy(column).limit(5).collect()
    return f", e.g. {[r[0] for r in found]}"


def require_valid(raw: DataFrame, earliest_year: int = fixed.EARLIEST_FISCAL_YEAR) -> None:
    """Run the rules as an action and raise on the first look at any violation."""
    kept = certified(latest_filings(raw))
    _refuse(violations(kept, earliest_year).first().asDict(), kept)


def write_cleaned(
    raw: DataFrame,
    path: str,
    tech_only: bool = True,
    earliest_year: int = fixed.EARLIEST_FISCAL_YEAR,
) -> None:
    """Write the cleaned table and check the rules in the same pass.

    The counts ride along as observed metrics. A repeated task can raise a count but
    never make a violation disappear, so comparing with zero is safe. The rows go to a
    folder beside ``path``, which takes its place once they are known to be valid and goes
    if they are not: a refused write leaves the table that was there.
    """
    write_cleaned_latest(latest_filings(raw), path, tech_only, earliest_year)


def write_cleaned_latest(
    latest: DataFrame, path: str, tech_only: bool = True, earliest_year: int = fixed.EARLIEST_FISCAL_YEAR
) -> None:
    """``write_cleaned`` for filings that are the latest of their cases already."""
    kept = certified(latest)
    seen = Observation("rules")
    out = cleaned_layout(kept.observe(seen, *violation_counts(kept, earliest_year)), earliest_year)
    if tech_only:
        out = out.filter(text.is_tech(F.col("soc_code")))
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}"
    try:
        out.write.parquet(fresh)
        _refuse(seen.get, kept)
    except BaseException:
        remove(latest.sparkSession, fresh)
        raise
    replace(latest.sparkSession, fresh, path)
