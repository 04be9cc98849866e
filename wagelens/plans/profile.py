"""Profiling reports over the deduplicated and the cleaned filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens import fixed
from wagelens.functions import text, wages
from wagelens.functions.dates import lenient_date
from wagelens.operators.latest import state_paths
from wagelens.operators.quantiles import ranked_quantiles
from wagelens.operators.summaries import (
    distinct_before_after,
    largest,
    numeric_summary,
    unpivot_counts,
    value_shares,
    with_single_row,
)
from wagelens.plans.clean import annualized
from wagelens.session import staged
from wagelens.sources.filings import POSITION

SUMMARY_FRACTIONS = {"p01": 0.01, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p99": 0.99}
ESCAPE_PRONE = ("JOB_TITLE", "SOC_CODE", "EMPLOYER_NAME", "WORKSITE_CITY", "SOC_TITLE")


def status_transitions(raw: DataFrame, source: str) -> DataFrame:
    """Which status sequences the cases seen more than once went through, in filing order: by
    decision date, undated last, then by source, then by row."""
    order = [lenient_date(F.col("DECISION_DATE"), raw.schema["DECISION_DATE"].dataType), F.col(source)]
    if POSITION in raw.columns:
        order.append(F.col(POSITION))
    return state_paths(raw, "CASE_NUMBER", "CASE_STATUS", order, "path", "n_cases")


def unit_mix(latest: DataFrame) -> DataFrame:
    return value_shares(latest, "WAGE_UNIT_OF_PAY", "n_rows", "share")


def _naive(latest: DataFrame) -> DataFrame:
    """Low end times its unit, deliberately without repair."""
    dtype = latest.schema["WAGE_RATE_OF_PAY_FROM"].dataType
    low = wages.to_wage(F.col("WAGE_RATE_OF_PAY_FROM"), dtype)
    return latest.withColumn("naive", low * wages.unit_multiplier(F.col("WAGE_UNIT_OF_PAY")))


def naive_summary(latest: DataFrame) -> DataFrame:
    naive = staged(_naive(latest).select("naive"), "naive")
    return numeric_summary(naive, "naive", SUMMARY_FRACTIONS)


def worst_offenders(latest: DataFrame, k: int = 5) -> DataFrame:
    columns = ["naive", "WAGE_RATE_OF_PAY_FROM", "WAGE_UNIT_OF_PAY", "JOB_TITLE", "EMPLOYER_NAME"]
    return largest(_naive(latest), "naive", k, ["CASE_NUMBER"]).select("CASE_NUMBER", *columns)


def hourly_suspects(latest: DataFrame, rate_above: float = 500.0) -> DataFrame:
    """Hourly rows by whether the rate is plausible, with each side's median rate."""
    dtype = latest.schema["WAGE_RATE_OF_PAY_FROM"].dataType
    hourly = latest.filter(F.col("WAGE_UNIT_OF_PAY") == "Hour").select(
        wages.to_wage(F.col("WAGE_RATE_OF_PAY_FROM"), dtype).alias("rate")
    ).filter(F.col("rate").isNotNull())
    judged = staged(hourly.withColumn("suspect", F.col("rate") > rate_above), "hourly")
    return ranked_quantiles(judged, ["suspect"], "rate", {"median_rate": 0.5}, "n_rows")


def repair_impact(latest: DataFrame, huge: float = 1e7) -> DataFrame:
    """Before and after unit repair: rows repaired, extremes, rows above ``huge``, medians."""
    both = staged(
        annualized(_naive(latest)).select("naive", "annual_from", "unit_repaired"), "repair"
    )
    out = both.agg(
        F.count_if("unit_repaired").alias("n_repaired"),
        F.max("naive").alias("max_before"),
        F.max("annual_from").alias("max_after"),
        F.count_if(F.col("naive") > huge).alias("n_huge_before"),
        F.count_if(F.col("annual_from") > huge).alias("n_huge_after"),
        F.mean("naive").alias("mean_before"),
        F.mean("annual_from").alias("mean_after"),
    )
    for column, name in (("naive", "median_before"), ("annual_from", "median_after")):
        out = with_single_row(out, ranked_quantiles(both, [], column, {name: 0.5}, "_n").drop("_n"))
    return out


def repaired_units(latest: DataFrame) -> DataFrame:
    """Which filed units needed repair."""
    return (
        annualized(latest)
        .filter("unit_repaired")
        .groupBy("WAGE_UNIT_OF_PAY")
        .agg(F.count(F.lit(1)).alias("n_repaired"))
    )


def beyond_repair(latest: DataFrame) -> DataFrame:
    """Rows above the ceiling that no unit explains, per filed unit."""
    a = F.col("annual_from")
    inside = F.coalesce(a.between(fixed.OUTLIER_LO, fixed.OUTLIER_HI), F.lit(False))
    return (
        annualized(_naive(latest))
        .filter((F.col("naive") > fixed.PLAUSIBLE_HI) & ~inside)
        .groupBy("WAGE_UNIT_OF_PAY")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def outlier_position(latest: DataFrame) -> DataFrame:
    """Rows below, inside and above the reporting band after repair: one row."""
    a = F.col("annual_from")
    return annualized(latest).agg(
        F.count_if(a < fixed.OUTLIER_LO).alias("n_below"),
        F.count_if(a > fixed.OUTLIER_HI).alias("n_above"),
        F.count_if(a.between(fixed.OUTLIER_LO, fixed.OUTLIER_HI)).alias("n_inside"),
        F.count_if(
            a.between(fixed.OUTLIER_LO, fixed.OUTLIER_HI) & wages.outside_band(F.col("annual_wage"))
        ).alias("n_missed_by_floor"),
    )


def _banded(latest: DataFrame) -> DataFrame:
    low, high = F.col("annual_from"), F.col("annual_to")
    wanted = annualized(latest).select(
        low, high, "annual_wage", wages.has_band(low, high).alias("has_band")
    )
    return staged(wanted, "banded")


def band_coverage(latest: DataFrame) -> DataFrame:
    """How many filings give a high end, how many a real band, and how wide it is."""
    banded = _banded(latest)
    low, high = F.col("annual_from"), F.col("annual_to")
    counts = banded.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(high).alias("n_high_end"),
        F.count_if("has_band").alias("n_band"),
    )
    spread = banded.filter("has_band").select(F.try_divide(high - low, low).alias("spread"))
    widths = ranked_quantiles(spread, [], "spread", {"median_spread": 0.5, "p90_spread": 0.9}, "_n")
    return with_single_row(counts, widths.drop("_n"))


def midpoint_bias(latest: DataFrame) -> DataFrame:
    """Median and p75 of the floor against the midpoint, over all plausible rows and over banded ones."""
    low = F.col("annual_from")
    plausible = _banded(latest).filter(low.between(fixed.OUTLIER_LO, fixed.OUTLIER_HI))
    # Two long tables of (scope, measure, value), reduced together.
    scopes = F.when(F.col("has_band"), F.array(F.lit("all"), F.lit("banded"))).otherwise(
        F.array(F.lit("all"))
    )
    long = plausible.select(
        F.explode(scopes).alias("scope"), "annual_from", "annual_wage"
    )
    fractions = {"median": 0.5, "p75": 0.75}
    floor = ranked_quantiles(
        long, ["scope"], "annual_from", {f"{k}_floor": f for k, f in fractions.items()}, "n_rows"
    )
    middle = ranked_quantiles(
        long, ["scope"], "annual_wage", {f"{k}_midpoint": f for k, f in fractions.items()}, "_n"
    ).drop("_n")
    joined = floor.join(middle, "scope")
    for name in fractions:
        ratio = F.col(f"{name}_midpoint") / F.col(f"{name}_floor") - 1
        joined = joined.withColumn(f"{name}_difference", F.round(ratio, 6))
    return joined


def escape_rates(latest: DataFrame) -> DataFrame:
    """(column, n_rows) of values still wearing a spreadsheet's wrapper."""
    counts = latest.agg(*[F.count_if(text.has_escape(F.col(c))).alias(c) for c in ESCAPE_PRONE])
    return unpivot_counts(counts, "column", "n_rows")


def naive_filter_loss(latest: DataFrame) -> DataFrame:
    """Tech filings found with and without unescaping the occupation code."""
    raw_code = text.strip(F.col("SOC_CODE"))
    fixed_code = text.strip(text.unescape(raw_code))
    return latest.agg(
        F.count_if(text.is_tech(raw_code)).alias("n_naive"),
        F.count_if(text.is_tech(fixed_code)).alias("n_fixed"),
    ).withColumn("n_lost", F.col("n_fixed") - F.col("n_naive"))


def employer_fragmentation(latest: DataFrame) -> DataFrame:
    name = F.col("EMPLOYER_NAME")
    return distinct_before_after(latest, text.unescape(name), text.normalize_employer(name))


def city_fragmentation(latest: DataFrame) -> DataFrame:
    city = F.col("WORKSITE_CITY")
    return distinct_before_after(latest, city, text.strip(F.upper(city)))


def names_containing(latest: DataFrame, part: str) -> DataFrame:
    """Distinct unescaped employer names that contain a text, in any case."""
    name = text.unescape(F.col("EMPLOYER_NAME"))
    return (
        latest.select(name.alias("employer_name"))
        .filter(F.contains(F.lower("employer_name"), F.lower(F.lit(part))))
        .distinct()
    )


def _tech(latest: DataFrame) -> DataFrame:
    return latest.filter(text.is_tech(text.strip(text.unescape(F.col("SOC_CODE")))))


def top_occupations(latest: DataFrame, k: int = 10) -> DataFrame:
    counts = _tech(latest).groupBy("SOC_TITLE").agg(F.count(F.lit(1)).alias("n_filings"))
    return largest(counts, "n_filings", k, ["SOC_TITLE"])


def top_cities(latest: DataFrame, k: int = 8) -> DataFrame:
    """Largest (city, state) groups by filings; a missing place is no group."""
    city: Column = text.title_case(F.col("WORKSITE_CITY"))
    counts = (
        _tech(latest)
        .filter(F.col("WORKSITE_CITY").isNotNull() & F.col("WORKSITE_STATE").isNotNull())
        .groupBy(city.alias("city"), F.col("WORKSITE_STATE").alias("state"))
        .agg(F.count("CASE_NUMBER").alias("n_filings"))
    )
    return largest(counts, "n_filings", k, ["city", "state"])


def status_mix(latest: DataFrame) -> DataFrame:
    return value_shares(latest, "CASE_STATUS", "n_rows", "share")


def visa_mix(latest: DataFrame) -> DataFrame:
    return value_shares(latest, "VISA_CLASS", "n_rows", "share")
