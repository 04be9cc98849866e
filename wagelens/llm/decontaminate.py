"""Benchmark passages inside documents, by SimHash of item-sized windows.

Texts are lower-cased words of letters and digits; a shingle is five of them, weighted by how
often it occurs. A window has as many shingles as an item, fewer at a text's end. All windows
are taken that hold one of the item's seeds, its first fifth of shingles and one more: a
stretch with a similarity of at least 0.8, even one cut short, lacks at most a fifth of an
item's shingles, so a seed is there, wherever in the window. Windows and items of one size are joined on the blocks of their SimHash: with more
blocks than the radius has bits, two fingerprints within the radius agree in a block. The
exact weighted-shingle similarity decides. The radius itself loses some: about 2.6 in 10,000
windows at a similarity of exactly 0.8, more where shingles with heavy weights differ.

Built-in functions only; nothing here runs Python on rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wagelens.llm.tables import bound, free_name, row_key
from wagelens.session import staged

WIDTH = 5
SIMILARITY = 0.8
BLOCK_BITS, BLOCKS = 3, 21  # 63 bits
RADIUS = BLOCKS - 1
_BITMAP_BITS = 20  # the driver holds 2^20 bits at most, whatever the benchmark's size


def _shingles(text: Column) -> Column:
    """Hashes of a whole text's shingles in order; none below ``WIDTH`` words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    none = F.array().cast("array<bigint>")
    return bound(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda own: F.when(
            F.size(own) >= WIDTH,
            F.transform(
                F.sequence(F.lit(0), F.size(own) - WIDTH),
                lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(WIDTH)]),
            ),
        ).otherwise(none),
    )


def _simhash(hashes: str) -> Column:
    """63 bits, each the majority of that bit over all shingle occurrences."""
    return F.expr(
        f"transform(sequence(0, {BLOCKS * BLOCK_BITS - 1}), b -> if(2 * aggregate({hashes}, 0, "
        f"(n, x) -> n + cast(shiftright(x, b) & 1 AS INT)) > size({hashes}), 1, 0))"
    )


def _blocks(bits: str) -> Column:
    parts = " + ".join(f"{1 << j} * {bits}[{BLOCK_BITS} * k + {j}]" for j in range(BLOCK_BITS))
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), k -> {parts})")


def _distance(one: str, other: str) -> Column:
    return F.expr(f"aggregate(zip_with({one}, {other}, (x, y) -> abs(x - y)), 0, (n, x) -> n + x)")


def _similarity(one: str, other: str) -> Column:
    """Sum of the smaller by the sum of the larger multiplicities."""
    both = (
        f"aggregate(array_distinct({one}), 0, (n, x) -> n + least("
        f"size(filter({one}, y -> y = x)), size(filter({other}, y -> y = x))))"
    )
    return F.expr(f"{both} / (size({one}) + size({other}) - {both})")


def _bitmap(hashes: DataFrame) -> Column:
    """A test for membership in ``hashes (h)`` that errs only by saying yes."""
    slot = F.shiftrightunsigned("h", 64 - _BITMAP_BITS)
    words = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, %d) & 63 AS INT))" % (64 - _BITMAP_BITS))).alias("bits")
    )
    values = np.zeros(1 << (_BITMAP_BITS - 6), dtype=np.int64)
    for row in words.collect():
        values[row.word] = row.bits
    return F.lit(values)


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), _shingles(F.col("text")).alias("item"))
    return staged(items.where(F.size("item") > 0).withColumn("bits", _simhash("item")), "benchmark_items")


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``key, doc_id, start, m, hashes``: the item-sized windows of all documents, each once."""
    size = F.size("item")
    seeds = items.select(
        size.alias("m"), F.explode(F.slice("item", 1, F.floor(size / 5).cast("int") + 1)).alias("h")
    ).distinct()
    seeds = staged(seeds, "benchmark_seeds")
    longest = seeds.agg(F.max("m")).first()[0] or 1
    bitmap = _bitmap(seeds.select("h"))

    def present(h: Column) -> Column:
        slot = F.shiftrightunsigned(h, 64 - _BITMAP_BITS)
        word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    hashed = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        _shingles(F.col("text")).alias("all"),
    )
    # explode_outer: the inner form would add a filter that computes the places twice.
    places = F.filter(
        F.transform("all", lambda h, i: F.when(present(h), i)), lambda i: i.isNotNull()
    )
    found = hashed.select("key", "doc_id", "all", F.explode_outer(places).alias("place")).where("place IS NOT NULL")
    low = F.greatest(F.col("place") - (longest - 1), F.lit(0))
    around = found.select(
        "key", "doc_id", "place", low.alias("low"), F.get("all", "place").alias("h"),
        F.slice("all", low + 1, F.col("place") - low + longest).alias("near"),
    )
    # A window belongs to the first seed it holds, so it starts after the seed before that one.
    earlier = F.lag("place").over(Window.partitionBy("key", "m").orderBy("place"))
    first = F.greatest(F.col("place") - F.col("m") + 1, F.lit(0), earlier + 1)
    # Rows that repeat a whole row stand at the same places and start nothing.
    owned = around.join(seeds, "h").withColumn("first", first).where("first <= place")
    return (
        owned.withColumn("start", F.explode(F.sequence("first", "place")))
        .select("key", "doc_id", "start", "m", F.slice("near", F.col("start") - F.col("low") + 1, F.col("m")).alias("hashes"))
    )


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``key, doc_id, item_id, start_word, similarity``: every window that holds an item.

    ``key`` names the row by id and text, so rows that repeat both are found together. Null
    or empty texts and texts and items under five words match nothing; items that repeat a
    text are all reported.
    """
    items = _items(benchmark)
    windows = staged(_windows(docs, items), "windows")
    # Windows with the same shingles are compared once.
    content = F.struct("m", F.xxhash64("hashes"), F.xxhash64("hashes", F.lit(1)), F.size("hashes"))
    named = windows.withColumn("content", F.xxhash64(content)).withColumn("content2", F.xxhash64(F.lit(7), content))
    distinct = named.groupBy("content", "content2").agg(F.first("m").alias("m"), F.first("hashes").alias("hashes"))
    distinct = staged(distinct.withColumn("bits", _simhash("hashes")), "window_contents")
    theirs = items.select("item_id", F.size("item").alias("m"), F.posexplode(_blocks("bits")).alias("block", "value"))
    ours = distinct.select("content", "content2", "m", F.posexplode(_blocks("bits")).alias("block", "value"))
    near = ours.join(theirs, ["m", "block", "value"]).select("content", "content2", "item_id").distinct()
    verified = (
        near.join(distinct.withColumnRenamed("bits", "own_bits"), ["content", "content2"])
        .join(items, "item_id")
        .where(_distance("own_bits", "bits") <= RADIUS)
        .withColumn("similarity", _similarity("hashes", "item"))
        .where(F.col("similarity") >= similarity)
        .select("content", "content2", "item_id", "similarity")
    )
    verified = staged(verified, "verified_windows")
    return named.drop("hashes").join(verified, ["content", "content2"]).select(
        "key", "doc_id", "item_id", F.col("start").cast("bigint").alias("start_word"), "similarity"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; columns stay as they are."""
    key = free_name(docs.columns, "row_key")
    found = contaminations(docs, benchmark).select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, similarity``: one row per document and item it holds."""
    return contaminations(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.countDistinct("start_word").alias("n_windows"), F.round(F.max("similarity"), 6).alias("similarity")
    )
