"""Read quarterly filing tables as one DataFrame.

A source is one published quarter: a Parquet or CSV file, or a folder of part files
written by Spark. Quarters differ in their column sets and sometimes in a column's type,
so those of one schema are read together, brought to common types, and united by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagelens import fixed
from wagelens.functions.dates import lenient_date
from wagelens.sources.quoted import FILE, ROW, read_quoted_csv
from wagelens.sources.versions import current_path, file_system

KEY = "CASE_NUMBER"
DEDUPE_COLUMNS = (KEY, "DECISION_DATE")
POSITION = "_position"
_RANK = "_rank"

_DATES = ("DECISION_DATE", "RECEIVED_DATE")
_WAGES = ("WAGE_RATE_OF_PAY_FROM", "WAGE_RATE_OF_PAY_TO", "PREVAILING_WAGE")


def find_sources(spark: SparkSession, folder: str, pattern: str = "LCA_*.parquet") -> list[str]:
    """Matching sources in name order; strays are ignored, an empty match is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(status.getPath()) for status in files.globStatus(path) or [])
    if not found:
        raise FileNotFoundError(f"no source matches {pattern} in {folder}")
    return found


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One source without its blank padding rows. The key column is found by name."""
    return _without_padding(_stored(spark, path), path).drop(FILE, ROW)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """A source as it is stored. The part files of a folder may differ in their columns."""
    if path.endswith(".csv"):
        return read_quoted_csv(spark, path)
    return spark.read.option("mergeSchema", True).parquet(current_path(spark, path))


def _without_padding(df: DataFrame, path: str) -> DataFrame:
    if KEY not in df.columns:
        raise ValueError(f"{path}: no {KEY} column; got {df.columns[:5]}")
    return df.filter(F.col(KEY).isNotNull())


@dataclass(frozen=True)
class Sources:
    """Sources that one scan reads: the rank and path of each, and their common schema."""

    ranks: tuple[int, ...]
    paths: tuple[str, ...]
    schema: T.StructType
    df: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.schema.fieldNames() if c not in (FILE, ROW)]


# Schemas are read by small jobs, so many at a time.
_SCHEMA_READERS = 16


def grouped_sources(spark: SparkSession, paths: Sequence[str]) -> list[Sources]:
    """The sources by schema: Parquet sources of equal columns and types are one scan.

    A CSV file is a scan of its own. Each group's ``df`` has ``_rank``, the place of the row's source
    among ``paths``, and no blank padding rows.
    """
    with ThreadPoolExecutor(_SCHEMA_READERS) as pool:
        stored = list(pool.map(lambda path: _stored(spark, path), paths))
    alike: dict[object, list[int]] = {}
    for rank, (path, df) in enumerate(zip(paths, stored)):
        _without_padding(df, path)
        same = path if path.endswith(".csv") else tuple(sorted((f.name, f.dataType.simpleString()) for f in df.schema))
        alike.setdefault(same, []).append(rank)
    return [_group(spark, paths, stored, ranks) for ranks in alike.values()]


def _group(spark: SparkSession, paths: Sequence[str], stored: list[DataFrame], ranks: list[int]) -> Sources:
    own, schema = [paths[r] for r in ranks], stored[ranks[0]].schema
    if len(ranks) == 1:
        df = stored[ranks[0]].withColumn(_RANK, F.lit(ranks[0]))
    else:
        folders = [current_path(spark, path) for path in own]
        df = spark.read.schema(schema).parquet(*folders).withColumn(_RANK, _rank_of(spark, dict(zip(folders, ranks))))
    return Sources(tuple(ranks), tuple(own), schema, _without_padding(df, own[0]))


def _rank_of(spark: SparkSession, ranks: dict[str, int]) -> Column:
    """Which source a row's file belongs to: it is the file, or the folder the file lies in."""
    known: dict[str, int] = {}
    for folder, rank in ranks.items():
        files, place = file_system(spark, folder)
        # A local path is written with one slash or three.
        uri = files.makeQualified(place).toUri().toString()
        known |= {uri: rank, uri.replace(":///", ":/", 1): rank}
    table = F.create_map(*[F.lit(part) for pair in known.items() for part in pair])
    path = F.col("_metadata.file_path")
    folder = F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    unknown = F.raise_error(F.concat(F.lit("no source for "), path)).cast("int")
    return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, folder), unknown)


def _position(path: str) -> Column:
    """A value that orders rows as they were filed: by source, part file, row.

    Four fixed-size fields, as every row carries them through a shuffle. Part files go by
    their number; the hash only keeps files without one apart.
    """
    csv = path.endswith(".csv")
    name = F.substring_index(FILE, "/", -1) if csv else F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"^part-(\d{1,9})\D", 1).try_cast("int")
    row = F.col(ROW) if csv else F.col("_metadata.row_index")
    return F.struct(
        F.col(_RANK).alias("source"),
        F.coalesce(part, F.lit(0)).alias("part"),
        F.xxhash64(name).alias("file"),
        row.alias("row"),
    )


def read_filings(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """All sources united by name, with ``_position`` telling which row came later.

    Sources of one schema are one scan. Only the needed columns are selected, so a Parquet
    scan reads nothing else. A column some source lacks is null there; one that no source
    has is an error.
    """
    groups = grouped_sources(spark, paths)
    present = {c for g in groups for c in g.columns}
    # Without a choice every column that some source has; deduplication's are always read.
    wanted = sorted(present if columns is None else set(columns).union(DEDUPE_COLUMNS))
    missing = [c for c in wanted if c not in present]
    if missing:
        raise ValueError(f"no source has the columns {missing}")
    as_text = {c for c in wanted for g in groups if c in g.columns and isinstance(g.schema[c].dataType, T.StringType)}

    def common(group: Sources, column: str) -> Column:
        dtype = group.schema[column].dataType
        if column in _DATES:
            return lenient_date(F.col(column), dtype)
        if column in as_text:
            return F.col(column).cast("string")
        return F.col(column).cast("double") if column in _WAGES else F.col(column)

    parts = [
        g.df.select(
            *[common(g, c).alias(c) for c in wanted if c in g.columns], _position(g.paths[0]).alias(POSITION)
        )
        for g in groups
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def load_filings(
    spark: SparkSession,
    folder: str,
    pattern: str = "LCA_*.parquet",
    columns: Sequence[str] | None = tuple(fixed.SOURCE_COLUMNS),
) -> DataFrame:
    """Find, read and unite; deduplication is the cleaning plan's first step."""
    return read_filings(spark, find_sources(spark, folder, pattern), columns)


def source_inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows and columns per source, and how its columns differ from the first source's.

    A group of sources is counted in one scan of its key column. What is known of the schemas is
    a small table beside the counts, so a source without rows is listed too.
    """
    groups = grouped_sources(spark, paths)
    columns = {rank: set(g.columns) for g in groups for rank in g.ranks}
    base = columns[0]
    known = [
        (rank, path.rstrip("/").rsplit("/", 1)[-1], len(columns[rank]),
         ",".join(sorted(columns[rank] - base)), ",".join(sorted(base - columns[rank])))
        for rank, path in enumerate(paths)
    ]
    described = spark.createDataFrame(known, f"{_RANK} int, source string, n_columns int, added string, removed string")
    counted = reduce(
        DataFrame.unionByName, [g.df.groupBy(_RANK).agg(F.count(F.lit(1)).alias("n_rows")) for g in groups]
    )
    return (
        described.join(counted, _RANK, "left").orderBy(_RANK)
        .select("source", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_columns", "added", "removed")
    )
