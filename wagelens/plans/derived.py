"""A filings table derived from orders, customers, nations and regions.

The given test tables hold no wage filings. This text turns every order into one: with
escapes, case and space variants, missing places and dates, all five units, mislabelled
units, bands, outliers on both sides, dropped statuses, and cases published twice. It
runs unchanged in Spark and in an ANSI engine, so both sides of a check read the same
filings. Order keys past six digits carry over into the day part of the case number,
which keeps case numbers unique; its five digits hold keys up to 74,999,999,999, and a larger one
makes a malformed number, which the cleaning rules refuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EARLIEST_YEAR = 1995

FILINGS_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_totalprice AS p, CAST(o_orderdate AS DATE) AS d, c_custkey AS ck,
         c_mktsegment AS seg, n_name AS city, r_name AS st
  FROM {orders} JOIN {customer} ON c_custkey = o_custkey
  JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey),
w AS (
  SELECT *,
    CASE WHEN k % 41 = 0 THEN NULL WHEN k % 53 = 0 THEN p * 10 WHEN k % 43 = 0 THEN p
         WHEN k % 7 = 0 THEN floor(p * 100 / 2080) / 100 WHEN k % 11 = 0 THEN floor(p * 100 / 12) / 100
         WHEN k % 13 = 0 THEN floor(p * 100 / 52) / 100 WHEN k % 17 = 0 THEN floor(p * 100 / 26) / 100
         ELSE p END AS wage_from,
    CASE WHEN k % 41 = 0 THEN 'Year' WHEN k % 53 = 0 THEN 'Year' WHEN k % 43 = 0 THEN 'Hour'
         WHEN k % 7 = 0 THEN 'Hour' WHEN k % 11 = 0 THEN 'Month' WHEN k % 13 = 0 THEN 'Week'
         WHEN k % 17 = 0 THEN 'Bi-Weekly' ELSE 'Year' END AS wage_unit
  FROM base),
one AS (
  SELECT k,
    concat('I-20', CAST(k % 4 AS STRING), '-', CAST(25001 + CAST(floor(k / 1000000) AS BIGINT) AS STRING),
           '-', lpad(CAST(k % 1000000 AS STRING), 6, '0')) AS case_number,
    CASE WHEN k % 29 = 0 THEN 'Denied' WHEN k % 31 = 0 THEN 'Withdrawn' ELSE 'Certified' END AS case_status,
    CASE WHEN k % 37 = 0 THEN 'E-3 Australian' ELSE 'H-1B' END AS visa_class,
    CASE WHEN k % 97 = 0 THEN NULL ELSE d END AS decision_date, d AS received_date,
    concat(CASE k % 3 WHEN 0 THEN 'Customer ' WHEN 1 THEN 'CUSTOMER ' ELSE 'customer, ' END, CAST(ck AS STRING),
           CASE k % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', L.L.C.' WHEN 2 THEN ' CORPORATION' ELSE '' END) AS employer_name,
    CASE k % 5 WHEN 0 THEN concat('="', seg, ' "Sr" Engineer"') WHEN 1 THEN concat(lower(seg), ' engineer')
               WHEN 2 THEN concat(seg, ' ENGINEER') WHEN 3 THEN concat(seg, ' Engineer ')
               ELSE concat(seg, ' Engineer') END AS job_title,
    CASE k % 6 WHEN 0 THEN '="15-1252.00"' WHEN 1 THEN '15-2051.00' WHEN 2 THEN '11-3021.00'
               WHEN 3 THEN '29-1216.00' ELSE '15-1252' END AS soc_code,
    CASE k % 6 WHEN 1 THEN 'Data Scientists' WHEN 2 THEN 'Computer and Information Systems Managers'
               WHEN 3 THEN 'Physicians' ELSE 'Software Developers' END AS soc_title,
    CASE WHEN k % 211 = 0 THEN NULL WHEN k % 3 = 0 THEN lower(city) WHEN k % 3 = 1 THEN concat(' ', city, ' ')
         ELSE city END AS worksite_city,
    CASE k % 2 WHEN 0 THEN lower(st) ELSE st END AS worksite_state,
    wage_from, CASE WHEN k % 3 = 0 THEN wage_from * 1.25 END AS wage_to, wage_unit,
    CASE WHEN k % 59 = 0 THEN p ELSE floor(p * 100 / 2080) / 100 END AS prevailing_wage, 'Hour' AS pw_unit,
    CASE WHEN k % 19 = 0 THEN 'N' ELSE 'Y' END AS full_time_position
  FROM w)
SELECT *, 1 AS src FROM one
UNION ALL
SELECT k, case_number, 'Certified - Withdrawn', visa_class, CAST(decision_date + INTERVAL 30 DAY AS DATE), received_date,
  employer_name, job_title, soc_code, soc_title, worksite_city, worksite_state, wage_from, wage_to, wage_unit,
  prevailing_wage, pw_unit, full_time_position, 2 FROM one WHERE k % 50 = 0 AND case_status = 'Certified'
"""

SOURCES = ("orders", "customer", "nation", "region")

# derived name -> published name, where they are not the same but for case
_PUBLISHED = {
    "wage_from": "WAGE_RATE_OF_PAY_FROM",
    "wage_to": "WAGE_RATE_OF_PAY_TO",
    "wage_unit": "WAGE_UNIT_OF_PAY",
    "pw_unit": "PW_UNIT_OF_PAY",
}


def derived_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw filings in the published layout, with ``_position`` for ties and ``src`` as the quarter."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}
    df = spark.sql(FILINGS_SQL, **tables)
    published = [
        F.col(c).alias(_PUBLISHED.get(c, c.upper())) for c in df.columns if c not in ("k", "src")
    ]
    return df.select(*published, "src", F.struct("src", "k").alias("_position"))
