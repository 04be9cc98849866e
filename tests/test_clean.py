import datetime as dt

import pytest
from pyspark.sql import functions as F

from wagelens import fixed
from wagelens.plans import clean as cleaning
from wagelens.plans import ledger


# ---- fixed values: the wages, units and dates below are acceptance cases ----------


def cleaned_row(filings, types=None, **override):
    rows = cleaning.clean(filings(override, types=types)).collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("wage, unit, expected", [
    (60.0, "Hour", 124_800.0), (10_000.0, "Month", 120_000.0), (2_000.0, "Week", 104_000.0),
    (4_000.0, "Bi-Weekly", 104_000.0), (100_000.0, "Year", 100_000.0),
])
def test_annualized_by_unit(filings, wage, unit, expected):
    row = cleaned_row(filings, WAGE_RATE_OF_PAY_FROM=wage, WAGE_UNIT_OF_PAY=unit)
    assert row.annual_wage == expected and not row.unit_repaired


def test_annual_figure_filed_as_hourly_is_repaired(filings):
    row = cleaned_row(filings, WAGE_RATE_OF_PAY_FROM=173_104.0, WAGE_UNIT_OF_PAY="Hour")
    assert row.annual_wage == 173_104.0 and row.unit_repaired


def test_one_repair_decision_for_both_ends(filings):
    row = cleaned_row(filings, WAGE_RATE_OF_PAY_FROM=150_000.0, WAGE_RATE_OF_PAY_TO=170_000.0, WAGE_UNIT_OF_PAY="Hour")
    assert (row.annual_from, row.annual_to, row.annual_wage) == (150_000.0, 170_000.0, 160_000.0)


def test_a_wide_band_is_flagged_by_its_middle(filings):
    row = cleaned_row(filings, WAGE_RATE_OF_PAY_TO=9_000_000.0)
    assert row.annual_wage == 4_550_000.0 and row.is_outlier


def test_five_million_is_an_outlier_and_no_unit_error(filings):
    row = cleaned_row(filings, WAGE_RATE_OF_PAY_FROM=5_000_000.0)
    assert row.is_outlier and not row.unit_repaired


@pytest.mark.parametrize("wage", [None, 0.0])
def test_missing_and_zero_wages_are_kept_and_flagged(filings, wage):
    row = cleaned_row(filings, WAGE_RATE_OF_PAY_FROM=wage)
    assert row.annual_wage == wage and row.is_outlier is True


def test_prevailing_wage_has_its_own_repair_and_flag(filings):
    row = cleaned_row(filings, PREVAILING_WAGE=173_104.0, PW_UNIT_OF_PAY="Hour")
    assert row.prevailing_wage == 173_104.0 and row.pw_repaired
    row = cleaned_row(filings, WAGE_RATE_OF_PAY_FROM=200_000.0, PREVAILING_WAGE=9_565_244.0)
    assert not row.is_outlier and row.pw_outlier


def test_text_wages_parse_and_flags_are_not_null(filings):
    text = {"WAGE_RATE_OF_PAY_FROM": "string", "PREVAILING_WAGE": "string"}
    row = cleaned_row(filings, text, WAGE_RATE_OF_PAY_FROM="100000", PREVAILING_WAGE="95000")
    assert row.annual_wage == 100_000.0
    assert [row.is_outlier, row.pw_outlier, row.unit_repaired, row.pw_repaired] == [False] * 4


def test_columns_and_their_number(filings):
    assert len(cleaning.clean(filings()).columns) == 21


@pytest.mark.parametrize("status, rows", [
    ("Certified", 1), ("Certified - Withdrawn", 1), ("Withdrawn", 0), ("Denied", 0), (None, 0),
])
def test_only_committed_statuses_stay(filings, status, rows):
    assert cleaning.clean(filings({"CASE_STATUS": status})).count() == rows


def test_visa_filter(filings):
    df = filings({}, {"VISA_CLASS": "E-3 Australian"}, {"VISA_CLASS": None})
    assert cleaning.of_visa_class(df).count() == 1


def test_tech_only(filings):
    df = filings({}, {"SOC_CODE": "29-1216.00"}, {"SOC_CODE": None}, {"SOC_CODE": "11-3021.00"})
    assert cleaning.clean(df).count() == 2
    assert cleaning.clean(df, tech_only=False).count() == 4


def test_missing_decision_falls_back_to_received(filings):
    row = cleaned_row(filings, DECISION_DATE=None, RECEIVED_DATE=dt.date(2025, 11, 1))
    assert row.fiscal_year == 2026 and row.decision_date is None


def test_a_year_from_the_received_date_is_not_before_the_first(filings):
    row = cleaned_row(filings, DECISION_DATE=None, RECEIVED_DATE=dt.date(2023, 3, 21))
    assert row.fiscal_year == fixed.EARLIEST_FISCAL_YEAR


def test_place_is_normalized_and_missing_full_time_is_false(filings):
    row = cleaned_row(filings, FULL_TIME_POSITION=None)
    assert (row.worksite_city, row.worksite_state, row.full_time) == ("Austin", "TX", False)


# ---- latest state ----------------------------------------------------------------


def test_later_decision_wins_whatever_the_row_order(filings):
    case = {"CASE_NUMBER": "I-200-25001-000001"}
    df = filings(
        {**case, "CASE_STATUS": "Withdrawn", "DECISION_DATE": dt.date(2025, 4, 2)},
        {**case, "DECISION_DATE": dt.date(2025, 3, 30)},
    )
    assert [r.CASE_STATUS for r in cleaning.latest_filings(df).collect()] == ["Withdrawn"]


def test_missing_decision_date_counts_as_latest(filings):
    case = {"CASE_NUMBER": "I-200-25001-000001"}
    df = filings({**case, "DECISION_DATE": None, "CASE_STATUS": "Denied"}, {**case})
    assert [r.CASE_STATUS for r in cleaning.latest_filings(df).collect()] == ["Denied"]


def test_equal_dates_go_to_the_later_row(filings):
    case = {"CASE_NUMBER": "I-200-25001-000001"}
    df = filings({**case, "CASE_STATUS": "Certified"}, {**case, "CASE_STATUS": "Denied"})
    df = df.withColumn("_position", F.when(F.col("CASE_STATUS") == "Denied", 2).otherwise(1))
    assert [r.CASE_STATUS for r in cleaning.latest_filings(df).collect()] == ["Denied"]


# ---- rules -----------------------------------------------------------------------


@pytest.mark.parametrize("override, types, message", [
    ({"WAGE_UNIT_OF_PAY": "Fortnight"}, None, "WAGE_UNIT_OF_PAY unmapped.*Fortnight"),
    ({"WAGE_UNIT_OF_PAY": None}, None, "WAGE_UNIT_OF_PAY unmapped"),
    ({"PW_UNIT_OF_PAY": "Fortnight"}, None, "PW_UNIT_OF_PAY unmapped"),
    ({"PW_UNIT_OF_PAY": None}, None, "PW_UNIT_OF_PAY unmapped"),
    ({"WAGE_RATE_OF_PAY_FROM": None, "WAGE_RATE_OF_PAY_TO": 140_000.0}, None, "no _FROM"),
    ({"WAGE_RATE_OF_PAY_FROM": "$120,000"}, {"WAGE_RATE_OF_PAY_FROM": "string"}, r"not numbers.*\$120,000"),
    ({"DECISION_DATE": dt.date(2023, 9, 30)}, None, "decided before FY2024"),
    ({"DECISION_DATE": None, "RECEIVED_DATE": None}, None, "without any date"),
    ({"CASE_NUMBER": "I-200-25001-1"}, None, "case number malformed"),
])
def test_broken_rules_raise_before_and_during_the_write(filings, tmp_path, override, types, message):
    raw = filings({}, override, types=types)
    with pytest.raises(cleaning.BadFilings, match=message):
        cleaning.require_valid(raw)
    with pytest.raises(cleaning.BadFilings, match=message):
        cleaning.write_cleaned(raw, str(tmp_path / "cleaned"))


def test_sound_filings_pass(filings, tmp_path, spark):
    raw = filings({}, {"SOC_CODE": "29-1216"}, {"WAGE_RATE_OF_PAY_TO": 140_000.0})
    cleaning.require_valid(raw)
    path = str(tmp_path / "cleaned")
    cleaning.write_cleaned(raw, path)
    assert spark.read.parquet(path).count() == 2


def test_rules_look_at_committed_filings_only(filings):
    cleaning.require_valid(filings({"CASE_STATUS": "Denied", "WAGE_UNIT_OF_PAY": "Fortnight"}))


# ---- ledger ----------------------------------------------------------------------


def ledger_rows(filings):
    return filings(
        {}, {"CASE_NUMBER": "I-200-25001-000001", "DECISION_DATE": dt.date(2025, 3, 1)},
        {"CASE_STATUS": "Denied"}, {"CASE_STATUS": None}, {"SOC_CODE": "29-1216"},
        {"SOC_CODE": '="15-1252.00"'},
    )


def test_ledger_accounts_for_every_row(filings):
    raw = ledger_rows(filings)
    expected = {
        "rows read": 6, "duplicate cases": 1, "unique filings": 5, "not certified": 2,
        "not tech": 1, "rows out": 2,
    }
    assert ledger.reconciled_ledger(raw, cleaning.clean(raw)) == expected
    assert {r.stage: r.n_rows for r in ledger.stage_ledger(raw).collect()} == expected


def test_ledger_without_the_tech_filter(filings):
    raw = ledger_rows(filings)
    stages = ledger.reconciled_ledger(raw, cleaning.clean(raw, tech_only=False), tech_only=False)
    assert (stages["not tech"], stages["rows out"]) == (0, 3)


def test_ledger_refuses_a_table_of_other_data(filings):
    with pytest.raises(ValueError, match="should be left"):
        ledger.reconciled_ledger(ledger_rows(filings), cleaning.clean(filings()))


def test_rows_read_may_come_from_an_earlier_step(filings):
    unique = filings({}, {}, {"CASE_STATUS": "Denied"})
    cleaned = cleaning.clean(unique)
    stages = ledger.reconciled_ledger(unique, cleaned, rows_read=5)
    assert (stages["rows read"], stages["duplicate cases"], stages["rows out"]) == (5, 2, 2)
    with pytest.raises(ValueError, match="cannot hold"):
        ledger.reconciled_ledger(unique, cleaned, rows_read=2)


def test_text_dates_are_ordered_as_dates(filings):
    case = {"CASE_NUMBER": "I-200-25001-000009"}
    raw = filings(
        {**case, "DECISION_DATE": "9/30/2024", "JOB_TITLE": "older"},
        {**case, "DECISION_DATE": "10/15/2024", "JOB_TITLE": "newer"},
        types={"DECISION_DATE": "string"},
    )
    assert [r.JOB_TITLE for r in cleaning.latest_filings(raw).collect()] == ["newer"]
    assert ledger.stage_row(raw).first()["unique filings"] == 1


def test_a_refused_write_leaves_the_table_as_it_was(spark, filings, tmp_path):
    path = tmp_path / "cleaned"
    cleaning.write_cleaned(filings({}, {}), str(path))
    with pytest.raises(cleaning.BadFilings):
        cleaning.write_cleaned(filings({"WAGE_RATE_OF_PAY_FROM": float("inf")}), str(path))
    assert spark.read.parquet(str(path)).count() == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["cleaned"]
    cleaning.write_cleaned(filings({}), str(path))
    assert spark.read.parquet(str(path)).count() == 1


def test_a_wage_that_is_no_number_is_missing(filings):
    row = cleaning.clean(filings({"WAGE_RATE_OF_PAY_FROM": float("nan")})).first()
    assert row.annual_wage is None and row.is_outlier
