"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, lengthened until no column has it, whatever the case."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base += "_"
    return base


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that name a row by its id and text: rows that repeat both share a key."""
    parts = [F.coalesce(c.cast("string"), F.lit("\0")) for c in (doc_id, text)]
    return F.unhex(F.md5(F.concat_ws("\1", *parts)))


def held_out(doc_id: Column) -> Column:
    """Every fifth row by the checksum of its id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
