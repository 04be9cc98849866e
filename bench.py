"""Benchmark: build the star once, then time the headline questions.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data
and the cores. Prints one JSON line; each figure is the median of three runs after one
warm-up run, and ``value`` is the sum over the questions.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from wagelens.plans import clean as cleaning
from wagelens.plans import questions as q
from wagelens.plans import star as stars
from wagelens.plans.derived import EARLIEST_YEAR, derived_filings
from wagelens.registry import CITY, STATE, TITLE, YEAR
from wagelens.session import local_session, staging_path

RUNS = 3


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("wagelens-bench", cores)

    root = staging_path(spark, "bench")
    raw = derived_filings(spark, sf_dir)
    pipeline = {
        "clean_and_write": timed(
            lambda: cleaning.write_cleaned(raw, f"{root}/cleaned", earliest_year=EARLIEST_YEAR)
        )
    }
    cleaned = spark.read.parquet(f"{root}/cleaned")
    pipeline["build_star"] = timed(lambda: stars.build_star(cleaned, root))
    star = stars.open_star(spark, root)

    questions = {
        "salary_percentiles": lambda: q.salary_percentiles(star),
        "salary_percentiles_title": lambda: q.salary_percentiles(star, job_title=TITLE),
        "salary_percentiles_slice": lambda: q.salary_percentiles(star, TITLE, CITY, STATE, YEAR),
        "salary_percentiles_outliers": lambda: q.salary_percentiles(star, include_outliers=True),
        "wage_distribution": lambda: q.wage_distribution(star),
        "wage_distribution_title": lambda: q.wage_distribution(star, job_title=TITLE),
        "top_employers": lambda: q.top_employers(star),
        "top_employers_title": lambda: q.top_employers(star, job_title=TITLE),
        "salary_by_city": lambda: q.salary_by_city(star),
        "salary_by_city_title": lambda: q.salary_by_city(star, job_title=TITLE),
        "salary_trend": lambda: q.salary_trend(star),
        "salary_trend_title": lambda: q.salary_trend(star, job_title=TITLE),
        "title_search": lambda: q.title_search(star, "ma"),
        "fiscal_years": lambda: q.fiscal_years(star),
    }

    def answer(ask) -> None:
        # Every run finds its title and place again.
        ask().collect()

    seconds = {}
    for name, ask in questions.items():
        answer(ask)
        seconds[name] = statistics.median(timed(lambda: answer(ask)) for _ in range(RUNS))

    # The pipeline once more, warm.
    again = staging_path(spark, "bench")
    pipeline["clean_and_write_warm"] = timed(
        lambda: cleaning.write_cleaned(raw, f"{again}/cleaned", earliest_year=EARLIEST_YEAR)
    )
    warm = spark.read.parquet(f"{again}/cleaned")
    pipeline["build_star_warm"] = timed(lambda: stars.build_star(warm, again))

    print(
        json.dumps(
            {
                "metric": "seconds for all headline questions on the star",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "pipeline": {name: round(s, 3) for name, s in pipeline.items()},
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
