"""Named queries over the derived filings, one per operator or report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagelens import fixed
from wagelens.functions import dates, text, wages
from wagelens.functions.cases import case_number, case_prefix, case_serial
from wagelens.operators import checks
from wagelens.operators.latest import repeated_keys, rows_of_repeated_keys
from wagelens.operators.positions import positions_within
from wagelens.operators.quantiles import count_over, grouped_quantiles, quantile_over, ranked_quantiles
from wagelens.plans import clean as cleaning
from wagelens.plans import ledger, profile, questions, star
from wagelens.plans.derived import EARLIEST_YEAR, SOURCES, derived_filings
from wagelens.session import staging_path
from wagelens.sources import filings as sources
from wagelens.sources import sinks, versions

Query = Callable[[SparkSession, str], DataFrame]

# A title, place and year that exist in the derived filings.
TITLE, CITY, STATE, YEAR = "machinery ENGINEER", "nation_7", "europe", 1997


# ---- tables --------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_filings(spark, sf_dir)


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.latest_filings(_raw(spark, sf_dir))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(_raw(spark, sf_dir), earliest_year=EARLIEST_YEAR)


_stars: dict[tuple, star.Star] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When each table that the filings derive from was last written."""
    found = [versions.file_system(spark, f"{sf_dir}/{name}.parquet") for name in SOURCES]
    return tuple(files.getFileStatus(place).getModificationTime() for files, place in found)


def built_star(spark: SparkSession, sf_dir: str) -> star.Star:
    """The star of a data folder: written once per session and state of its tables, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _stars:
        root = staging_path(spark, "star")
        cleaned = f"{root}/cleaned"
        cleaning.write_cleaned(_raw(spark, sf_dir), cleaned, earliest_year=EARLIEST_YEAR)
        star.build_star(spark.read.parquet(cleaned), root)
        _stars[key] = star.open_star(spark, root)
    return _stars[key]


def _on_star(ask: Callable[..., DataFrame], **arguments) -> Query:
    return lambda spark, sf_dir: ask(built_star(spark, sf_dir), **arguments)


def _on_latest(report: Callable[..., DataFrame], **arguments) -> Query:
    return lambda spark, sf_dir: report(_latest(spark, sf_dir), **arguments)


# ---- cleaning ------------------------------------------------------------------


def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select(
        *[F.col(c).alias(c.lower()) for c in fixed.SOURCE_COLUMNS], F.col("src").alias("quarter")
    )


def committed_of_one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.of_visa_class(cleaning.certified(_latest(spark, sf_dir)))
    return kept.select(
        F.col("CASE_NUMBER").alias("case_number"),
        F.col("CASE_STATUS").alias("case_status"),
        F.col("VISA_CLASS").alias("visa_class"),
    )


def annualize_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.annualized(_latest(spark, sf_dir)).select(
        F.col("CASE_NUMBER").alias("case_number"),
        "annual_from",
        "annual_to",
        "unit_repaired",
        F.col("prevailing_wage_annual").alias("prevailing_wage"),
        "pw_repaired",
    )


def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).groupBy("is_outlier", "pw_outlier", "unit_repaired", "pw_repaired").agg(
        F.count(F.lit(1)).alias("n_filings"),
        F.sum(F.rint("annual_wage").cast("bigint")).alias("wage_sum"),
    )


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select(
        F.col("CASE_NUMBER").alias("case_number"),
        text.unescape(F.col("JOB_TITLE")).alias("job_title"),
        text.normalize_soc(F.col("SOC_CODE")).alias("soc_code"),
        text.is_tech(text.normalize_soc(F.col("SOC_CODE"))).alias("is_tech"),
    )


def employer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("EMPLOYER_NAME")
    return (
        _raw(spark, sf_dir)
        .groupBy(name.alias("employer_raw"), text.normalize_employer(name).alias("employer_name"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def city_state_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    city, state = F.col("WORKSITE_CITY"), F.col("WORKSITE_STATE")
    return (
        _raw(spark, sf_dir)
        .groupBy(text.normalize_city(city).alias("city"), text.normalize_state(state).alias("state"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = dates.fiscal_year(F.col("DECISION_DATE"), F.col("RECEIVED_DATE"), EARLIEST_YEAR)
    return (
        _raw(spark, sf_dir)
        .groupBy(year.alias("fiscal_year"), F.col("DECISION_DATE").isNull().alias("undecided"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("CASE_NUMBER")
    parts = _latest(spark, sf_dir).select(
        number.alias("case_number"),
        case_prefix(number).alias("case_prefix"),
        case_serial(number).alias("case_serial"),
    )
    return parts.withColumn("rebuilt", case_number(F.col("case_prefix"), F.col("case_serial")))


def wage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as filed text, some blank and some with a currency sign: read or refused."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, whole = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    filed = (
        F.when(key % 23 == 0, F.concat(F.lit("$"), whole))
        .when(key % 29 == 0, F.concat(whole, F.lit("d")))
        .when(key % 31 == 0, F.concat(F.lit(" "), whole, F.lit(".5 ")))
        .when(key % 37 != 0, whole)
    )
    df = orders.select("o_orderkey", filed.alias("filed"))
    dtype = df.schema["filed"].dataType
    return df.select(
        "o_orderkey",
        wages.to_wage(F.col("filed"), dtype).alias("wage"),
        wages.unreadable(F.col("filed"), dtype).alias("unreadable"),
    )


def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text in two notations and as junk, read leniently; rows per fiscal year."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    filed = (
        F.when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 3 == 1, F.date_format(day, "M/d/yyyy"))
        .otherwise("soon")
    )
    df = orders.select(filed.alias("filed"))
    read = dates.lenient_date(F.col("filed"), df.schema["filed"].dataType)
    return df.groupBy(dates.fiscal_year_of(read).alias("fiscal_year")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.certified(_latest(spark, sf_dir))
    counts = cleaning.violations(kept, EARLIEST_YEAR + 1)
    return counts.toDF(*[c.lower().replace(" ", "_") for c in counts.columns])


def unknown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual_units = ["Year", "Month"]
    return checks.unknown_values(_latest(spark, sf_dir), "WAGE_UNIT_OF_PAY", annual_units).select(
        F.col("WAGE_UNIT_OF_PAY").alias("unit"), "n_rows"
    )


# ---- sources and sinks ---------------------------------------------------------


def _published(spark: SparkSession, sf_dir: str) -> str:
    """The two derived quarters as Parquet sources; the second has one column more."""
    folder = staging_path(spark, "quarters")
    raw = _raw(spark, sf_dir).drop("_position")
    first, second = raw.filter("src = 1").drop("src"), raw.filter("src = 2").drop("src")
    later = second.withColumn("LAWFIRM_BUSINESS_FEIN", F.lit(None).cast("string"))
    sinks.write_cache(first, f"{folder}/LCA_Quarter_1.parquet")
    sinks.write_cache(later, f"{folder}/LCA_Quarter_2.parquet")
    return folder


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = sources.find_sources(spark, _published(spark, sf_dir))
    return sources.source_inventory(spark, paths)


def load_and_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published quarters, found, read, united and cleaned; summed up per year and status."""
    raw = sources.load_filings(spark, _published(spark, sf_dir))
    out = cleaning.clean(raw, tech_only=False, earliest_year=EARLIEST_YEAR)
    return out.groupBy("fiscal_year", "case_status").agg(
        F.count(F.lit(1)).alias("n_filings"),
        F.sum(F.rint("annual_wage").cast("bigint")).alias("wage_sum"),
    )


def curated_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated table, written by year and read back for one year."""
    path = sinks.write_curated(_cleaned(spark, sf_dir), staging_path(spark, "curated"))
    return (
        spark.read.parquet(path)
        .filter(F.col("fiscal_year") == YEAR)
        .select("case_number", "employer_name", "annual_wage", "is_outlier")
    )


# ---- constraints on data with planted faults --------------------------------------


def _with_faults(tables: star.Star) -> star.Star:
    """The star with faults of every kind: lost ids, nulls, repeated serials, keys and ids."""
    serial = F.col("case_serial")
    facts = tables.filings.withColumns({
        "employer_id": F.when(serial % 97 == 0, F.col("employer_id") + 1_000_000_000).otherwise(F.col("employer_id")),
        "title_id": F.when(serial % 89 == 0, None).otherwise(F.col("title_id")),
        "is_outlier": F.when(serial % 83 == 0, None).otherwise(F.col("is_outlier")),
    })
    employers, occupations = tables.employers, tables.occupations
    again = employers.filter("employer_id % 50 = 0").withColumn("employer_id", F.col("employer_id") + 2_000_000_000)
    return replace(
        tables,
        filings=facts.unionByName(facts.filter(serial % 101 == 0)),
        employers=employers.unionByName(again),
        occupations=occupations.withColumn("soc_title", F.when(F.col("soc_id") > 0, F.col("soc_title"))),
        titles=tables.titles.unionByName(tables.titles.filter("title_id % 3 = 0")),
        locations=tables.locations.filter("location_id % 4 <> 1"),
    )


def planted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.broken_rules(_with_faults(built_star(spark, sf_dir)))


# ---- windows -------------------------------------------------------------------


def _clean_wages(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = built_star(spark, sf_dir).filings
    return facts.filter("annual_wage is not null").select("case_serial", "fiscal_year", "location_id", "annual_wage")


def count_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_over(_clean_wages(spark, sf_dir), ["location_id"], "n_place").select(
        "case_serial", "location_id", "n_place"
    )


def percentile_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_over(
        _clean_wages(spark, sf_dir), ["location_id"], "annual_wage", questions.QUARTILES
    ).select("case_serial", "location_id", "p25", "p50", "p75")


def rank_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("annual_wage"), F.col("case_serial")]
    return positions_within(_clean_wages(spark, sf_dir), ["fiscal_year"], order, "position").select(
        "case_serial", "fiscal_year", "annual_wage", "position"
    )


def rank_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("annual_wage"), F.col("case_serial")]
    return positions_within(_clean_wages(spark, sf_dir), [], order, "position").select(
        "case_serial", "annual_wage", "position"
    )


def flat_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by employer on the flat cleaned table, without the star."""
    flat = _cleaned(spark, sf_dir).filter(~F.col("is_outlier")).select(
        "employer_name", F.rint("annual_wage").cast("bigint").alias("annual_wage")
    )
    return grouped_quantiles(flat, ["employer_name"], "annual_wage", questions.QUARTILES, "n_filings")


def flat_quantiles_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _cleaned(spark, sf_dir).select(
        "worksite_state", "full_time", F.rint("annual_wage").cast("bigint").alias("annual_wage")
    )
    return ranked_quantiles(
        flat, ["worksite_state", "full_time"], "annual_wage", questions.QUARTILES, "n_filings"
    )


# ---- reports -------------------------------------------------------------------


def cases_filed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_keys(_raw(spark, sf_dir), "CASE_NUMBER").toDF("case_number", "n_rows")


def rows_filed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select("CASE_NUMBER", "CASE_STATUS", "DECISION_DATE", "src")
    return rows_of_repeated_keys(raw, "CASE_NUMBER").select(
        F.col("CASE_NUMBER").alias("case_number"),
        F.col("CASE_STATUS").alias("case_status"),
        F.col("DECISION_DATE").alias("decision_date"),
        F.col("src").alias("quarter"),
    )


def differing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows that one quarter has and the other lacks, for cases in both."""
    twice = rows_filed_twice(spark, sf_dir)
    sides = [
        twice.filter(F.col("quarter") == q).select("case_number", "case_status") for q in (1, 2)
    ]
    return checks.differing_rows(*sides)


def paid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's table: label, median, count of the best paid places."""
    places = questions.salary_by_city(built_star(spark, sf_dir), job_title=TITLE)
    return places.limit(25).select(
        text.location_label(F.col("worksite_city"), F.col("worksite_state")).alias("location"),
        "median_wage",
        "n_filings",
    )


def _lower_columns(query: Query) -> Query:
    def lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.toDF(*[c.lower() for c in df.columns])

    return lowered


def _rounded(query: Query, digits: int, *columns: str) -> Query:
    """Sums of doubles depend on their order in the last digits; the report rounds them."""

    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir).withColumns({c: F.round(c, digits) for c in columns})

    return rounded


def _table(name: str) -> Query:
    return lambda spark, sf_dir: built_star(spark, sf_dir).table(name)


def all_queries() -> dict[str, Query]:
    q = questions
    slice_of = {"job_title": TITLE, "city": CITY, "state": STATE}
    return {
        # cleaning
        "dedupe_latest": dedupe_latest,
        "clean_filings": _cleaned,
        "committed_of_one_class": committed_of_one_class,
        "annualize_repair": annualize_repair,
        "outlier_flags": outlier_flags,
        "text_normalize": text_normalize,
        "employer_normalize": employer_normalize,
        "city_state_normalize": city_state_normalize,
        "fiscal_year": fiscal_year,
        "case_numbers": case_numbers,
        "wage_text": wage_text,
        "date_text": date_text,
        "rule_violations": rule_violations,
        "unknown_units": unknown_units,
        "stage_ledger": lambda spark, sf: ledger.stage_ledger(_raw(spark, sf)),
        # sources and sinks
        "source_inventory": source_inventory,
        "load_and_clean": load_and_clean,
        "curated_by_year": curated_by_year,
        # star
        **{f"lookup_{name}": _table(name) for name, *_ in star.LOOKUPS},
        "star_filings": _table("filings"),
        "star_view": _on_star(star.joined_view),
        "star_catalog": _on_star(star.catalog),
        "fk_orphans": _on_star(star.foreign_keys),
        "fact_nulls": _on_star(star.missing_values),
        "repeated_serials": _on_star(star.repeated_serials),
        "repeated_lookup_keys": _on_star(star.repeated_lookup_keys),
        "planted_faults": planted_faults,
        # questions
        "salary_percentiles": _on_star(q.salary_percentiles),
        "salary_percentiles_slice": _on_star(q.salary_percentiles, **slice_of, fiscal_year=YEAR),
        "salary_percentiles_empty": _on_star(q.salary_percentiles, job_title="No Such Title"),
        "salary_percentiles_outliers": _on_star(q.salary_percentiles, include_outliers=True),
        "wage_distribution": _on_star(q.wage_distribution),
        "wage_distribution_slice": _on_star(
            q.wage_distribution, job_title=TITLE, bin_width=25_000, include_outliers=True
        ),
        "distribution_tail": lambda spark, sf: q.distribution_tail(
            q.wage_distribution(built_star(spark, sf), include_outliers=True), 0.95
        ),
        "top_employers": _on_star(q.top_employers),
        "top_employers_slice": _on_star(q.top_employers, job_title=TITLE, city=CITY, limit=5),
        "salary_by_city": _on_star(q.salary_by_city),
        "salary_by_city_title": _on_star(q.salary_by_city, job_title=TITLE, min_filings=20),
        "paid_places": paid_places,
        "salary_trend": _on_star(q.salary_trend),
        "salary_trend_slice": _on_star(q.salary_trend, job_title=TITLE, city=CITY),
        "year_changes": lambda spark, sf: q.year_changes(q.salary_trend(built_star(spark, sf))),
        "title_search": _on_star(q.title_search, prefix="mA"),
        "title_search_all": _on_star(q.title_search, limit=10),
        "title_search_literal": _on_star(q.title_search, prefix="%"),
        "fiscal_years": _on_star(q.fiscal_years),
        # windows and flat quantiles
        "count_over": count_per_place,
        "percentile_over": percentile_per_place,
        "rank_per_year": rank_per_year,
        "rank_overall": rank_overall,
        "flat_quantiles": flat_quantiles,
        "flat_quantiles_by_rank": flat_quantiles_by_rank,
        # profile
        "duplicate_keys": cases_filed_twice,
        "rows_filed_twice": rows_filed_twice,
        "differing_states": differing_states,
        "transitions": lambda spark, sf: profile.status_transitions(_raw(spark, sf), "src"),
        "unit_mix": _lower_columns(_on_latest(profile.unit_mix)),
        "status_mix": _lower_columns(_on_latest(profile.status_mix)),
        "visa_mix": _lower_columns(_on_latest(profile.visa_mix)),
        "naive_summary": _rounded(
            _on_latest(profile.naive_summary), 0, "mean", "std", *profile.SUMMARY_FRACTIONS
        ),
        "worst_offenders": _lower_columns(_on_latest(profile.worst_offenders)),
        "hourly_suspects": _rounded(_on_latest(profile.hourly_suspects), 2, "median_rate"),
        "repair_impact": _rounded(
            _on_latest(profile.repair_impact), 0, "mean_before", "mean_after", "median_before", "median_after"
        ),
        "repaired_units": _lower_columns(_on_latest(profile.repaired_units)),
        "beyond_repair": _lower_columns(_on_latest(profile.beyond_repair)),
        "outlier_position": _on_latest(profile.outlier_position),
        "band_coverage": _rounded(_on_latest(profile.band_coverage), 6, "median_spread", "p90_spread"),
        "midpoint_bias": _rounded(
            _on_latest(profile.midpoint_bias), 0,
            "median_floor", "p75_floor", "median_midpoint", "p75_midpoint",
        ),
        "escape_rates": _on_latest(profile.escape_rates),
        "naive_filter_loss": _on_latest(profile.naive_filter_loss),
        "employer_fragmentation": _on_latest(profile.employer_fragmentation),
        "city_fragmentation": _on_latest(profile.city_fragmentation),
        "names_containing": _on_latest(profile.names_containing, part="Mer 12"),
        "top_occupations": _lower_columns(_on_latest(profile.top_occupations)),
        "top_cities": _on_latest(profile.top_cities),
    }
