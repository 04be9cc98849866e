"""One small session for all tests, and a raw filing to vary."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wagelens.session import local_session  # noqa: E402

# name, type, default
RAW_LAYOUT = [
    ("CASE_NUMBER", "string", "I-200-25001-000001"),
    ("CASE_STATUS", "string", "Certified"),
    ("VISA_CLASS", "string", "H-1B"),
    ("DECISION_DATE", "date", dt.date(2025, 1, 15)),
    ("RECEIVED_DATE", "date", dt.date(2024, 11, 1)),
    ("EMPLOYER_NAME", "string", "ACME INC"),
    ("JOB_TITLE", "string", "Software Engineer"),
    ("SOC_CODE", "string", "15-1252.00"),
    ("SOC_TITLE", "string", "Software Developers"),
    ("WORKSITE_CITY", "string", "austin"),
    ("WORKSITE_STATE", "string", "tx"),
    ("WAGE_RATE_OF_PAY_FROM", "double", 100_000.0),
    ("WAGE_RATE_OF_PAY_TO", "double", None),
    ("WAGE_UNIT_OF_PAY", "string", "Year"),
    ("PREVAILING_WAGE", "double", 95_000.0),
    ("PW_UNIT_OF_PAY", "string", "Year"),
    ("FULL_TIME_POSITION", "string", "Y"),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session("wagelens-tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def filings(spark):
    """``filings(dict, dict, ...)``: raw rows, numbered unless they name a case."""

    def make(*overrides, types=None):
        types = types or {}
        schema = ", ".join(f"{name} {types.get(name, kind)}" for name, kind, _ in RAW_LAYOUT)
        rows = []
        for i, override in enumerate(overrides or ({},), 1):
            row = {name: value for name, _, value in RAW_LAYOUT}
            row["CASE_NUMBER"] = f"I-200-25001-{i:06d}"
            row.update(override)
            rows.append(tuple(row[name] for name, _, _ in RAW_LAYOUT))
        return spark.createDataFrame(rows, schema)

    return make
