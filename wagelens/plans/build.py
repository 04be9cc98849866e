"""The batch build, end to end: quarters in, checked and published star out.

    python -m wagelens.plans.build <folder of quarters> <folder of the star>
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from wagelens import fixed
from wagelens.plans.clean import FILED, counted_latest, write_cleaned_latest
from wagelens.plans.ledger import balanced, counted_stage_row
from wagelens.plans.star import Star, build_star, catalog
from wagelens.session import staged
from wagelens.sources.filings import load_filings
from wagelens.sources.versions import replace_table


def build(
    spark: SparkSession,
    folder: str,
    root: str,
    pattern: str = "LCA_*.parquet",
    tech_only: bool = True,
    earliest_year: int = fixed.EARLIEST_FISCAL_YEAR,
) -> tuple[Star, dict[str, int]]:
    """The new star and the ledger of its rows.

    Sources are read and deduplicated once; the latest filings are staged for the ledger and the
    cleaned table, which is a version of ``<root>/cleaned`` and what the star reads. A broken rule or an unbalanced ledger raises before anything is
    published.
    """
    latest = staged(counted_latest(load_filings(spark, folder, pattern)), "latest")
    stages: dict[str, int] = {}

    def write(path: str) -> None:
        write_cleaned_latest(latest, path, tech_only, earliest_year)
        counts = counted_stage_row(latest, FILED, tech_only).first().asDict()
        stages.update(balanced(counts, spark.read.parquet(path)))

    path = replace_table(spark, f"{root}/cleaned", write)
    return build_star(spark.read.parquet(path), root), stages


if __name__ == "__main__":
    session = SparkSession.builder.appName("wagelens-build").getOrCreate()
    star, ledger = build(session, *sys.argv[1:3])
    for stage, rows in ledger.items():
        print(f"{stage:<16} {rows:>15,}")
    catalog(star).show()
