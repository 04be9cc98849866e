"""CSV whose quoted texts span lines, read by many tasks.

A line end is the end of a record unless it stands inside quotes, and whether it does depends
on every quote before it. So the quotes of each split are counted first; running sums over the
splits, one number each, tell every split whether it begins inside quotes. The tasks then put
together the records that lie in their split and pass on what is cut by its borders: at most a
rest at its start and a beginning at its end, which are joined across splits.

Quotes must come in pairs: a quote inside a text is doubled, as the reader's escape has it. A
file in which they do not is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where a record stands: its file, and a number that rises with its place there.
FILE, ROW = "_csv_file", "_csv_row"

_OPTIONS = {"header": True, "escape": '"', "multiLine": True}
_BATCH = 4_096
_PIECES = pa.schema([
    ("file", pa.string()), ("split", pa.int64()), ("row", pa.int64()), ("kind", pa.string()), ("text", pa.string()),
])
_PIECES_SQL = "file string, split bigint, row bigint, kind string, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )


def _inside(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Which splits begin inside quotes; one entry per split of a file."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "split").agg(F.sum(quotes).alias("quotes"))
    own = W.partitionBy("file").orderBy("split")
    before = F.coalesce(F.sum("quotes").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("split").over(own).isNull() & ((before + F.col("quotes")) % 2 == 1)
    rows = counted.select("file", "split", (before % 2 == 1).alias("inside"), last.alias("open")).collect()
    unpaired = [r.file for r in rows if r.open]
    if unpaired:
        raise ValueError(f"{unpaired[0]}: a quote without its pair")
    return {(r.file, r.split): r.inside for r in rows}


def _pieces(batches: Iterator[pa.RecordBatch], inside: dict[tuple[str, int], bool]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the cut ones: ``rest`` ends a record, ``begin`` begins one, ``middle`` does neither."""

    def rows() -> Iterator[tuple[str, int, int, str, str]]:
        place, held, first, number, quoted, cut = None, [], 0, 0, False, False
        for batch in batches:
            for file, split, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != place:
                    if held:
                        yield *place, first, "middle" if cut else "begin", "\n".join(held)
                    place, held, number = (file, split), [], 0
                    quoted = cut = inside[place]
                if not held:
                    first = split + number
                number += 1
                held.append(line)
                quoted ^= line.count('"') % 2 == 1
                if not quoted:
                    yield *place, first, "rest" if cut else "whole", "\n".join(held)
                    held, cut = [], False
        if held:
            yield *place, first, "middle" if cut else "begin", "\n".join(held)

    batch: list[tuple] = []
    for row in rows():
        batch.append(row)
        if len(batch) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), _PIECES)], schema=_PIECES)
            batch = []
    if batch:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), _PIECES)], schema=_PIECES)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, text) of every record, header and blank lines included."""
    lines = _lines(spark, path)
    pieces = lines.mapInArrow(partial(_pieces, inside=_inside(lines)), _PIECES_SQL)
    # At most two cut pieces a split; a beginning and what follows it are one record.
    order = W.partitionBy("file").orderBy("split", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = pieces.where("kind != 'whole'").withColumn("record", F.sum((F.col("kind") == "begin").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("split", "row", "text")))
    joined = cut.groupBy("file", "record").agg(F.min("row").alias("row"), F.array_join(parts["text"], "\n").alias("text"))
    return pieces.where("kind = 'whole'").select("file", "row", "text").unionByName(joined.select("file", "row", "text"))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a folder of them, with a header: text columns, and each record's place."""
    columns = spark.read.options(**_OPTIONS).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    records = _records(spark, path).where("row != 0").withColumn("text", F.regexp_replace("text", "\r$", ""))
    parsed = F.from_csv("text", schema.toDDL(), {"escape": '"'})
    return records.where("text != ''").select(parsed.alias("_r"), F.col("file").alias(FILE), F.col("row").alias(ROW)).select(
        "_r.*", FILE, ROW
    )
