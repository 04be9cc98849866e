"""Shards of nearly equal bytes by longest-processing-time scheduling.

Groups that must stay together, here equal texts, are sorted by size and go, largest first,
to the least loaded shard, which a heap names. A corpus has as many groups as texts, too many
for one heap. So only groups above ``1 / LARGE`` of all bytes, of which there are fewer than
``LARGE``, are scheduled one by one; the others are first poured by hash into bundles, whose
number is fixed. Bundles come in levels, each half the size of the level before, so that the
last ones scheduled are small and even out what the large ones left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.llm.tables import free_name
from wagelens.operators.positions import positions_within

LARGE = 4_096
LEVELS, BUNDLES = 12, 256  # at most LEVELS * BUNDLES bundles


def schedule(sizes: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time: the shard of each (name, size). Ties: by name, then shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(sizes, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(loads)
        placed[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def _bundle(group: Column) -> Column:
    """``level:number`` of a group: level l takes 2^-(l+1) of the groups, the last the rest."""
    draw = F.xxhash64(group, F.lit("level")).bitwiseAND((1 << LEVELS) - 1)
    level = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        level = F.when(draw.bitwiseAND(1 << i) != 0, F.lit(i)).otherwise(level)
    number = F.pmod(F.xxhash64(group, F.lit("bundle")), F.lit(BUNDLES))
    return F.concat_ws(":", F.lit("bundle"), level, number)


def balanced_shards(rows: DataFrame, group: str, size: str, shards: int, name: str = "shard") -> DataFrame:
    """``rows`` with the shard of their group; rows of equal ``group``, null included, share it.

    The driver sees one row per bundle and one per large group: fewer than
    ``LARGE + LEVELS * BUNDLES``, whatever the number of rows.
    """
    spark = rows.sparkSession
    key, unit, alone = (free_name(rows.columns, n) for n in ("group_key", "unit", "alone"))
    keyed = rows.withColumn(key, F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    total = rows.agg(F.sum(size)).first()[0] or 0
    groups = keyed.groupBy(key).agg(F.sum(size).alias("bytes"))
    large = [(r[0], r[1]) for r in groups.where(F.col("bytes") * LARGE > F.lit(total)).collect()]
    names = spark.createDataFrame([(k,) for k, _ in large], f"`{key}` string").withColumn(alone, F.lit(True))
    bundles = (
        groups.where(F.col("bytes") * LARGE <= F.lit(total))
        .groupBy(_bundle(F.col(key)).alias(unit)).agg(F.sum("bytes").alias("bytes"))
    )
    sizes = [(f"group:{k}", s) for k, s in large] + [(r[0], r[1]) for r in bundles.collect()]
    placed = schedule(sizes, shards)
    plan = spark.createDataFrame(list(placed.items()), f"`{unit}` string, `{name}` int")
    # Both broadcast tables are bounded by the numbers above.
    marked = keyed.join(F.broadcast(names), key, "left").withColumn(
        unit, F.when(F.col(alone), F.concat(F.lit("group:"), F.col(key))).otherwise(_bundle(F.col(key)))
    )
    return marked.join(F.broadcast(plan), unit).drop(unit, key, alone)


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document.

    Size is the UTF-8 length plus 1; a null text counts and groups as an empty one. Slots are
    gapless from 0 in each shard, by doc_id, null first. The law is ``bytes``: shards are
    nearly equal in bytes unless one group alone is larger than a shard's share.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("text_hash"),
    )
    placed = balanced_shards(rows, "text_hash", "size", shards)
    slotted = positions_within(
        placed.drop("text_hash"), ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot"
    )
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
