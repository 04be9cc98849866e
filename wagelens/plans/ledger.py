"""How many rows each stage of the cleaning takes away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens import fixed
from wagelens.functions import text
from wagelens.functions.dates import lenient_date
from wagelens.operators.latest import latest_per_key
from wagelens.operators.summaries import unpivot_counts
from wagelens.sources.filings import POSITION

# The stages, in order, as they are reported.
STAGES = (
    "rows read",
    "duplicate cases",
    "unique filings",
    "not certified",
    "not tech",
    "rows out",
)


def _after_deduplication(tech_only: bool) -> list[Column]:
    kept = F.coalesce(F.col("CASE_STATUS").isin(*fixed.KEEP_STATUSES), F.lit(False))
    tech = text.is_tech(text.normalize_soc(F.col("SOC_CODE"))) if tech_only else F.lit(True)
    return [
        F.count(F.lit(1)).alias("unique filings"),
        F.count_if(~kept).alias("not certified"),
        F.count_if(kept & ~tech).alias("not tech"),
        F.count_if(kept & tech).alias("rows out"),
    ]


def counted_stage_row(latest: DataFrame, filed: str, tech_only: bool = True) -> DataFrame:
    """The ledger from the latest filings and the number of rows each case had: one pass, no shuffle."""
    counts = latest.agg(F.coalesce(F.sum(filed), F.lit(0)).alias("rows read"), *_after_deduplication(tech_only))
    return counts.withColumn("duplicate cases", F.col("rows read") - F.col("unique filings")).select(*STAGES)


def stage_row(raw: DataFrame, tech_only: bool = True) -> DataFrame:
    """The ledger as one row, from the narrow columns that decide it.

    Rows read are counted beside the deduplication, not inside it, so the window keeps
    its one-row-per-key limit below the shuffle.
    """
    narrow = raw.select(
        "CASE_NUMBER",
        "DECISION_DATE",
        "CASE_STATUS",
        "SOC_CODE",
        *([POSITION] if POSITION in raw.columns else []),
    )
    decided = lenient_date(F.col("DECISION_DATE"), raw.schema["DECISION_DATE"].dataType)
    recency = [decided.desc_nulls_first()]
    if POSITION in narrow.columns:
        recency.append(F.col(POSITION).desc())
    latest = latest_per_key(narrow, "CASE_NUMBER", recency)
    after = latest.agg(*_after_deduplication(tech_only))
    read = narrow.agg(F.count(F.lit(1)).alias("_read")).scalar()
    full = after.withColumn("rows read", read).withColumn(
        "duplicate cases", F.col("rows read") - F.col("unique filings")
    )
    return full.select(*STAGES)


def stage_ledger(raw: DataFrame, tech_only: bool = True) -> DataFrame:
    """(stage, n_rows), one row per stage."""
    return unpivot_counts(stage_row(raw, tech_only), "stage", "n_rows")


def reconciled_ledger(
    raw: DataFrame, cleaned: DataFrame, tech_only: bool = True, rows_read: int | None = None
) -> dict[str, int]:
    """The ledger of ``raw`` as a dict, if it ends in as many rows as ``cleaned`` has.

    Where ``raw`` was deduplicated before, ``rows_read`` tells how many rows there were.
    """
    counts = stage_row(raw, tech_only).first().asDict()
    if rows_read is not None:
        counts["rows read"] = rows_read
        counts["duplicate cases"] = rows_read - counts["unique filings"]
    return balanced(counts, cleaned)


def balanced(counts: dict[str, int], cleaned: DataFrame) -> dict[str, int]:
    """The ledger in the order of its stages, if it adds up and ends in the rows of ``cleaned``."""
    if counts["duplicate cases"] < 0:
        raise ValueError(f"{counts['rows read']} rows read cannot hold {counts['unique filings']} different cases")
    found = cleaned.count()
    if found != counts["rows out"]:
        raise ValueError(f"{counts['rows out']} rows should be left, {found} are in the cleaned table")
    return {stage: counts[stage] for stage in STAGES}
