"""Parquet sinks, verified by reading back, and the optional database sink."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from wagelens.sources.versions import current_version as current_run
from wagelens.sources.versions import file_system, publish, remove, replace_table

__all__ = [
    "WriteMismatch", "clear_tables", "current_run", "publish", "recover", "remove", "replace", "verify_rows",
    "write_cache", "write_curated", "write_database",
]


class WriteMismatch(RuntimeError):
    """A written table does not hold what was to be written."""


def write_cache(df: DataFrame, path: str) -> str:
    """A source as a Parquet cache, replaced as a whole. Readers of sources follow the pointer
    inside ``path``; the folder of the new version is returned."""
    return replace_table(
        df.sparkSession, path, lambda folder: df.write.option("compression", "snappy").parquet(folder)
    )


def write_curated(cleaned: DataFrame, path: str) -> str:
    """The cleaned filings, one folder per fiscal year so that a year can be pruned; replaced as a
    whole, and the folder of the new version is returned.

    The rebalance hint brings a year's rows together, so that no task opens many files,
    and lets adaptive execution cut a year that holds most of the rows into several.
    """
    rows = cleaned.hint("rebalance", "fiscal_year")
    return replace_table(
        cleaned.sparkSession, path, lambda folder: rows.write.partitionBy("fiscal_year").parquet(folder)
    )


def verify_rows(spark: SparkSession, path: str, expected: int) -> int:
    """Count the table at ``path`` again and refuse a count other than ``expected``."""
    stored = spark.read.parquet(path).count()
    if stored != expected:
        raise WriteMismatch(f"{path} holds {stored:,} rows but {expected:,} were expected")
    return stored


# ---- database sink -----------------------------------------------------------


def clear_tables(
    spark: SparkSession, url: str, names: Sequence[str], properties: Mapping[str, str]
) -> None:
    """Empty tables in one transaction, in the given order.

    DELETE rather than the writer's TRUNCATE: several databases refuse to truncate a
    table that a foreign key names, even when nothing refers to its rows.
    """
    jvm = spark._jvm
    login = jvm.java.util.Properties()
    for key, value in properties.items():
        login.setProperty(key, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for name in names:
            statement.executeUpdate(f"DELETE FROM {name}")
        connection.commit()
    finally:
        connection.close()


def write_database(
    tables: Mapping[str, DataFrame],
    url: str,
    load_order: Sequence[str],
    properties: Mapping[str, str] | None = None,
    batch_rows: int = 10_000,
) -> None:
    """Replace the rows of existing tables over JDBC; columns are matched by name.

    Tables are emptied children first and filled parents first, as foreign keys demand.
    Executors insert their partitions in batches, each in its own transaction, so a
    failed load is repeated as a whole: it starts by emptying.
    """
    login = dict(properties or {})
    spark = tables[load_order[0]].sparkSession
    clear_tables(spark, url, list(reversed(load_order)), login)
    for name in load_order:
        tables[name].write.jdbc(
            url, name, mode="append", properties={**login, "batchsize": str(batch_rows)}
        )


# ---- plain folders -------------------------------------------------------------

_ASIDE = ".aside-"


def _set_aside(spark: SparkSession, path: str) -> list[str]:
    """Former folders of ``path`` that a replacement has put aside, oldest first."""
    files, place = file_system(spark, path)
    beside = place.getParent()
    if not files.exists(beside):
        return []
    prefix = f".{place.getName()}{_ASIDE}"
    return sorted(str(s.getPath()) for s in files.listStatus(beside) if s.getPath().getName().startswith(prefix))


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back the folder that an interrupted replacement has left aside, if ``path`` is gone."""
    files, place = file_system(spark, path)
    aside = _set_aside(spark, path)
    if files.exists(place) or not aside:
        return False
    return files.rename(file_system(spark, aside[-1])[1], place)


def replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts the folder ``fresh`` in the place of the plain folder ``path``.

    The old folder is put aside and goes last. If the move fails it comes back at once; if
    this process ends between the two moves, ``recover`` or the next replacement brings it back.
    For tables that are read while they are replaced, use ``replace_table``.
    """
    recover(spark, path)
    files, target = file_system(spark, path)
    for left in _set_aside(spark, path):
        remove(spark, left)
    aside = target.getParent().suffix(f"/.{target.getName()}{_ASIDE}{time.time_ns():020d}")
    held = files.exists(target)
    if held and not files.rename(target, aside):
        raise OSError(f"{path} could not be put aside")
    source = file_system(spark, fresh)[1]
    if not files.exists(source) or not files.rename(source, target):
        recover(spark, path)
        raise OSError(f"{fresh} could not be moved to {path}")
    if held:
        files.delete(aside, True)
