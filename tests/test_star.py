import dataclasses
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens.operators import checks
from wagelens.operators.topk import kept_by_count
from wagelens.plans import clean as cleaning
from wagelens.plans import questions as q
from wagelens.plans import star as stars
from wagelens.sources import sinks


@pytest.fixture(scope="session")
def build(filings, tmp_path_factory):
    """``build(row, row, ...)``: a star of raw rows, tech or not."""

    def make(*rows):
        cleaned = cleaning.clean(filings(*rows), tech_only=False)
        return stars.build_star(cleaned, str(tmp_path_factory.mktemp("star")))

    return make


def values(df, *columns):
    return [tuple(r) for r in df.select(*(columns or df.columns)).collect()]


# Names are not in alphabetical order: ids follow first appearance.
GOLDEN_ROWS = [
    {"EMPLOYER_NAME": e, "WORKSITE_CITY": c, "WORKSITE_STATE": s, "WAGE_RATE_OF_PAY_FROM": w}
    for e, c, s, w in [
        ("ZYLO INC", "seattle", "wa", 100_000.0), ("ZYLO INC", "seattle", "wa", 120_000.0),
        ("ACME", "seattle", "wa", 140_000.0), ("ACME", "austin", "tx", 160_000.0),
        ("MIDCO", "austin", "tx", 180_000.0),
    ]
]


@pytest.fixture(scope="module")
def golden(build):
    return build(*GOLDEN_ROWS)


def test_golden_lookups(golden):
    assert sorted(values(golden.employers)) == [(0, "ZYLO", "ZYLO INC"), (1, "ACME", "ACME"), (2, "MIDCO", "MIDCO")]
    assert values(golden.occupations) == [(0, "15-1252", "Software Developers")]
    assert values(golden.titles) == [(0, "Software Engineer")]
    assert sorted(values(golden.locations)) == [(0, "Seattle", "WA"), (1, "Austin", "TX")]
    assert values(golden.visa_classes) == [(0, "H-1B")]


def test_golden_filings(golden):
    got = sorted(values(golden.filings))
    ids = [(0, 0), (0, 0), (1, 0), (1, 1), (2, 1)]
    assert got == [
        (25001000001 + i, 200, employer, 0, 0, place, 0, wage, wage, None, 95_000, 2025,
         True, False, False, False, False, False)
        for i, ((employer, place), wage) in enumerate(zip(ids, range(100_000, 200_000, 20_000)))
    ]


def test_stored_types_are_the_stated_ones(golden, spark):
    for name, text in stars.SCHEMAS.items():
        assert checks.schema_differences(golden.table(name), T.StructType.fromDDL(text)) == []


def test_view_rebuilds_the_filing(golden, spark):
    golden.register()
    row = spark.sql("SELECT * FROM v_filings WHERE case_number = 'I-200-25001-000004'").first()
    assert (row.employer_name, row.worksite_city, row.annual_wage, row.case_status) == (
        "ACME", "Austin", 160_000, "Certified",
    )


def test_catalog_counts_every_table(golden):
    assert dict(values(stars.catalog(golden))) == {
        "employers": 3, "filings": 5, "locations": 2, "occupations": 1, "titles": 1, "visa_classes": 1,
    }


def test_a_sound_star_has_no_violations(golden):
    assert all(n == (t, 0, 0) for n, t in zip(values(stars.foreign_keys(golden)), stars.COLUMNS))
    assert set(values(stars.missing_values(golden))[0]) == {0}
    assert stars.repeated_serials(golden).count() == 0
    assert {n for _, n in values(stars.repeated_lookup_keys(golden))} == {0}


def test_payload_is_the_first_filing_in_case_order(build):
    star = build(
        {"CASE_NUMBER": "I-200-25002-000001", "EMPLOYER_NAME": "acme"},
        {"CASE_NUMBER": "I-200-25001-999999", "EMPLOYER_NAME": "Acme, Inc."},
        {"CASE_NUMBER": "I-201-25001-000001", "EMPLOYER_NAME": "BETA"},
    )
    assert sorted(values(star.employers)) == [(0, "ACME", "Acme, Inc."), (1, "BETA", "BETA")]


def test_titles_stay_byte_exact_and_places_are_never_null(build):
    star = build({"JOB_TITLE": "Analyst"}, {"JOB_TITLE": "ANALYST"}, {"JOB_TITLE": "Analyst "},
                 {"WORKSITE_CITY": None, "WORKSITE_STATE": None})
    assert star.titles.count() == 4
    assert ("", "") in values(star.locations, "worksite_city", "worksite_state")
    assert star.filings.filter("location_id IS NULL").count() == 0


def test_midpoint_is_stored_half_even_and_withdrawn_is_marked(build):
    star = build({"WAGE_RATE_OF_PAY_TO": 140_001.0, "CASE_STATUS": "Certified - Withdrawn"})
    assert values(star.filings, "annual_wage", "withdrawn") == [(120_000, True)]
    assert values(stars.joined_view(star), "case_status") == [("Certified - Withdrawn",)]


def test_shared_serials_are_refused(build):
    with pytest.raises(stars.BrokenStar, match="more than once"):
        build({"CASE_NUMBER": "I-200-25001-000001"}, {"CASE_NUMBER": "I-201-25001-000001"})


def test_malformed_case_numbers_are_refused(build):
    with pytest.raises(stars.BrokenStar, match="case_serial"):
        build({}, {"CASE_NUMBER": "I-200-25001-1"})


def test_a_failed_build_leaves_the_current_run(filings, tmp_path, spark):
    root = str(tmp_path)
    stars.build_star(cleaning.clean(filings({}, {})), root)
    broken = filings({"CASE_NUMBER": "I-200-25001-000001"}, {"CASE_NUMBER": "I-201-25001-000001"})
    with pytest.raises(stars.BrokenStar):
        stars.build_star(cleaning.clean(broken), root)
    assert stars.open_star(spark, root).filings.count() == 2
    stars.build_star(cleaning.clean(filings({}, {}, {})), root)
    assert stars.open_star(spark, root).filings.count() == 3


def test_a_wrong_count_is_refused(golden, tmp_path, spark):
    path = str(tmp_path / "t")
    golden.titles.write.parquet(path)
    with pytest.raises(sinks.WriteMismatch):
        sinks.verify_rows(spark, path, 2)


# ---- questions -------------------------------------------------------------------


@pytest.fixture(scope="module")
def asked(build):
    """Hand-computed slices, kept apart by their titles."""
    rows = [{"WAGE_RATE_OF_PAY_FROM": w * 100_000.0} for w in range(1, 9)]
    rows += [{"JOB_TITLE": "Data Analyst", "EMPLOYER_NAME": "ZETA LABS", "WAGE_RATE_OF_PAY_FROM": w * 100_000.0}
             for w in (1, 2, 3)]
    rows += [{"JOB_TITLE": "DATA ANALYST", "EMPLOYER_NAME": "ALPHA WORKS", "WAGE_RATE_OF_PAY_FROM": 500_000.0}]
    rows += [{"JOB_TITLE": "Data Analyst ", "WAGE_RATE_OF_PAY_FROM": 900_000.0}]
    rows += [{"JOB_TITLE": "City", "WORKSITE_CITY": c, "WAGE_RATE_OF_PAY_FROM": w}
             for c, w in [("austin", 1e5), ("AUSTIN ", 2e5), ("Austin", 3e5), ("denton", 4e5), ("denton", 5e5)]]
    rows += [{"JOB_TITLE": "Trend", "WAGE_RATE_OF_PAY_FROM": w, "DECISION_DATE": dt.date(y, 1, 15)}
             for y, w in [(2024, 1e5), (2025, 1.1e5)]]
    rows += [{"JOB_TITLE": t} for t in ("100% Remote", "C_ Dev", "C# Dev", "C++ Dev", "a\\b")]
    rows += [{"JOB_TITLE": "Odd", "WAGE_RATE_OF_PAY_FROM": w} for w in (1e5, 9e6, None)]
    return build(*rows)


def test_percentiles_interpolate(asked):
    assert values(q.salary_percentiles(asked, "software engineer")) == [(275000.0, 450000.0, 625000.0, 8)]


@pytest.mark.parametrize("arguments", [
    {"job_title": "No Such"}, {"city": "x'; DROP TABLE"}, {"fiscal_year": 1900}, {"state": "%"}, {"job_title": "_dd"},
])
def test_an_empty_slice_is_one_row(asked, arguments):
    assert values(q.salary_percentiles(asked, **arguments)) == [(None, None, None, 0)]


def test_titles_match_in_any_case_but_not_with_other_spaces(asked):
    assert values(q.salary_percentiles(asked, "dAtA aNaLySt"))[0][3] == 4
    assert values(q.salary_percentiles(asked, "Data Analyst "))[0][3] == 1


def test_city_state_and_year_filter(asked):
    assert values(q.salary_percentiles(asked, "City", city="austin", state="Tx", fiscal_year=2025))[0][3] == 3


def test_outliers_only_when_asked_for_and_never_without_a_wage(asked):
    assert values(q.salary_percentiles(asked, "Odd"))[0][3] == 1
    assert values(q.salary_percentiles(asked, "Odd", include_outliers=True)) == [(2325000.0, 4550000.0, 6775000.0, 2)]


def test_distribution_in_order_without_empty_bins(asked):
    got = values(q.wage_distribution(asked, "Data Analyst", bin_width=200_000))
    assert got == [(0, 1), (200_000, 2), (400_000, 1)]


def test_zero_width_is_refused(asked):
    with pytest.raises(ValueError, match="bin_width"):
        q.wage_distribution(asked, bin_width=0)


def test_top_employers_by_count_then_name(asked):
    assert values(q.top_employers(asked, "data analyst")) == [("ZETA LABS", 3, 200000.0), ("ALPHA WORKS", 1, 500000.0)]
    assert values(q.top_employers(asked, "data analyst", limit=1)) == [("ZETA LABS", 3, 200000.0)]
    assert values(q.top_employers(asked, limit=0)) == []
    assert values(q.top_employers(asked, "data analyst", limit=20_000)) == values(q.top_employers(asked, "data analyst"))


def test_ties_at_the_cut_are_settled_by_name(build):
    star = build(*[{"EMPLOYER_NAME": e} for e in ("GAMMA", "BETA", "ALPHA")])
    assert [r[0] for r in values(q.top_employers(star, limit=2))] == ["ALPHA", "BETA"]


def test_cities_need_enough_filings(asked):
    assert values(q.salary_by_city(asked, "City", min_filings=3)) == [("Austin", "TX", 200000.0, 3)]
    assert values(q.salary_by_city(asked, "City", min_filings=1)) == [
        ("Denton", "TX", 450000.0, 2), ("Austin", "TX", 200000.0, 3),
    ]


def test_trend_and_its_changes(asked):
    trend = q.salary_trend(asked, "Trend")
    assert values(trend) == [(2024, 100000.0, 1, None), (2025, 110000.0, 1, 10.0)]
    assert values(q.year_changes(trend), "fiscal_year") == [(2025,)]


def test_search_is_popular_first_and_folds_case(asked):
    assert values(q.title_search(asked, "data")) == [("DATA ANALYST", 4), ("Data Analyst ", 1)]
    assert values(q.title_search(asked, None, limit=1)) == [("Software Engineer", 8)]


@pytest.mark.parametrize("prefix, titles", [
    ("%", []), ("_ngineer", []), ("10%", []), ("100%", ["100% Remote"]), ("C_", ["C_ Dev"]), ("a\\", ["a\\b"]),
])
def test_search_prefix_is_literal(asked, prefix, titles):
    assert [r[0] for r in values(q.title_search(asked, prefix))] == titles


def test_search_counts_outliers(asked):
    assert values(q.title_search(asked, "odd")) == [("Odd", 3)]


def test_years_newest_first(asked):
    assert values(q.fiscal_years(asked)) == [(2025,), (2024,)]


@pytest.mark.parametrize("ask, error", [
    (lambda s: q.top_employers(s, limit=-1), ValueError),
    (lambda s: q.top_employers(s, limit=True), TypeError),
    (lambda s: q.title_search(s, limit="5"), TypeError),
    (lambda s: q.salary_percentiles(s, include_outliers="no"), TypeError),
    (lambda s: q.salary_percentiles(s, fiscal_year="2025"), TypeError),
    (lambda s: q.salary_percentiles(s, job_title=7), TypeError),
    (lambda s: q.salary_by_city(s, min_filings=1.5), TypeError),
])
def test_wrong_arguments_are_refused(asked, ask, error):
    with pytest.raises(error):
        ask(asked)


QUESTIONS = [
    lambda s: q.salary_percentiles(s, "data analyst"),
    lambda s: q.salary_percentiles(s, "City", city="AUSTIN", state="tX", fiscal_year=2025),
    lambda s: q.salary_percentiles(s, city="austin", include_outliers=True),
    lambda s: q.wage_distribution(s, state="tx"),
    lambda s: q.top_employers(s, "DATA analyst", limit=1),
    lambda s: q.salary_by_city(s, "city", min_filings=1),
    lambda s: q.salary_trend(s, "trend", city="austin"),
    lambda s: q.title_search(s, "c"),
    lambda s: q.title_search(s, ""),
]


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("ask", QUESTIONS)
def test_a_star_without_stored_keys_answers_the_same(asked, ask):
    bare = dataclasses.replace(asked, keyed=None, search=None)
    assert values(ask(bare)) == values(ask(asked))


@pytest.mark.parametrize("ask", QUESTIONS)
def test_no_job_runs_while_a_question_is_planned(asked, spark, ask):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("planning", "a question")
    try:
        ask(asked)
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        context.setJobGroup("tests", "")


def test_title_and_year_reach_the_scan_and_no_lookup_is_read(asked):
    plan = formatted(q.salary_percentiles(asked, "Trend", fiscal_year=2025))
    assert re.search(r"PushedFilters: .*EqualTo\(title_key", plan)
    partitions = re.search(r"PartitionFilters: .*", plan).group()
    assert "fiscal_year" in partitions and "title_block" in partitions
    assert len(re.findall(r"\n\(\d+\) Scan parquet", plan)) == 1
    assert "Join" not in plan and "employer_id" not in plan


def test_a_place_is_a_pushed_filter_too(asked):
    plan = formatted(q.salary_percentiles(asked, city="Austin", state="TX"))
    assert re.search(r"PushedFilters: .*EqualTo\(city_key.*EqualTo\(state_key", plan)
    assert "Join" not in plan


def test_a_prefix_is_a_pushed_range_of_the_counted_titles(asked):
    plan = formatted(q.title_search(asked, "Da"))
    assert "StringStartsWith(folded,da)" in plan
    assert "title_counts" in plan and "filings" not in plan


def test_a_title_prunes_folders(asked, build, monkeypatch):
    monkeypatch.setattr(stars, "BLOCK_ROWS", 1)
    star = build(*[{"JOB_TITLE": t, "WAGE_RATE_OF_PAY_FROM": 1e5} for t in ("Able", "able", "Baker", "Fox", "Dog", "Cat")])
    assert star.block_bits == 3
    for title, n in (("ABLE", 2), ("baker", 1), ("None", 0)):
        assert values(q.salary_percentiles(star, title))[0][3] == n
    assert star.keyed.select("title_block").distinct().count() > 1


def test_folders_hold_a_bounded_number_of_filings():
    assert [stars.block_bits(n) for n in (0, 1, stars.BLOCK_ROWS, stars.BLOCK_ROWS + 1, 10**13)] == [0, 0, 0, 1, 12]


def test_names_join_only_what_reaches_the_cut(build):
    star = build(*[{"EMPLOYER_NAME": e} for e in ("A", "A", "A", "B", "B", "C", "C", "D")])
    assert [r[0] for r in values(q.top_employers(star, limit=2))] == ["A", "B"]
    counted = star.filings.groupBy("employer_id").agg(F.count("*").alias("n"))
    assert sorted(r.n for r in kept_by_count(counted, "n", 2).collect()) == [2, 2, 3]
    assert kept_by_count(counted, "n", 0).count() == 0
    assert kept_by_count(counted, "n", 99).count() == 4


def test_a_limit_beyond_what_can_be_taken_is_refused(asked):
    with pytest.raises(ValueError, match="limit"):
        q.top_employers(asked, limit=2**31)


def test_flags_in_the_view_equal_the_cleaned_table(build, filings):
    star = build(*GOLDEN_ROWS)
    cleaned = cleaning.clean(filings(*GOLDEN_ROWS), tech_only=False)
    columns = ["case_number", "employer_name", "job_title", "soc_code", "worksite_city", "is_outlier", "fiscal_year"]
    same = checks.differing_rows(stars.joined_view(star).select(*columns), cleaned.select(*columns))
    assert same.count() == 0


def test_wages_wider_than_32_bits_are_kept(build):
    star = build({"WAGE_RATE_OF_PAY_FROM": 2_000_001.0, "WAGE_UNIT_OF_PAY": "Hour"})
    assert values(star.filings, "annual_wage", "is_outlier") == [(2_000_001 * 2080, True)]
    asked = q.salary_percentiles(star, include_outliers=True).first()
    assert (asked.p50, asked.n_filings) == (2_000_001.0 * 2080, 1)


@pytest.mark.parametrize("column", ["JOB_TITLE", "EMPLOYER_NAME", "SOC_TITLE"])
def test_missing_lookup_text_is_refused(build, column):
    with pytest.raises(stars.BrokenStar, match="nulls"):
        build({}, {column: None, "CASE_NUMBER": "I-200-25001-999999", "SOC_CODE": "15-2051.00"})


def test_a_sound_star_breaks_no_constraint(golden):
    rows = stars.broken_rules(golden).collect()
    assert len(rows) == len(stars.CONSTRAINTS)
    assert {(r.n_keys, r.n_rows) for r in rows} == {(0, 0)}


def test_a_table_of_another_layout_is_refused(filings, tmp_path, monkeypatch):
    stated = stars.SCHEMAS["titles"].replace("title_id bigint", "title_id int")
    monkeypatch.setitem(stars.SCHEMAS, "titles", stated)
    monkeypatch.setattr(stars, "_check", lambda star: None)
    with pytest.raises(Exception, match="title_id"):
        stars.build_star(cleaning.clean(filings({})), str(tmp_path))
    assert not list(tmp_path.glob("run-*"))
