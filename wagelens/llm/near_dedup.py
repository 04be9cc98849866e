"""Near-duplicate documents: MinHash, banding, verification and connected components.

Documents with the same set of shingles form one class, so exact copies cost nothing further.
Classes that agree in a band are compared in steps, each among what is not yet in one
component. First each class with the smallest of its bucket, which links large groups of
copies at the cost of one row per class; then with other members of the bucket, drawn for
each band; last, in buckets where several components are left, the members outside the
largest component with all members of other components. Inside a step a class is first
compared with the one it shares most bands with, and only then, where that has not put them
into one component, with the others. Every pair of a bucket is thereby either in one component
or compared, without caps and without writing out the pairs of a group of copies. Pairs whose
signatures differ too much leave before their texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagelens.llm.components import components
from wagelens.session import staged

# 45 bands of 7: a pair at similarity 0.8 shares no band with a chance of 3 in 100,000, one at 0.85
# of 1 in 10 million; a pair at 0.2 shares one with a chance of 6 in 10,000.
BANDS, ROWS = 45, 7
# Draws of a partner for each class before all that is left is compared.
DRAWS = 1
# Deviations that a pair's signature bits may be off: 3 in a million similar pairs are further off.
_DEVIATIONS = 4.5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SIGNED = "id bigint, n bigint, class binary, bands array<bigint>, bits array<bigint>"
_BITS = BANDS * ROWS


def _most_differing(percent: int) -> int:
    """Signatures keep a bit of each minimum. A pair at the similarity asked for differs in
    half of the minima that differ; some deviations more are let through."""
    share = (1 - percent / 100) / 2
    return int(_BITS * share + _DEVIATIONS * (_BITS * share * (1 - share)) ** 0.5) + 1


def _alike(percent: int) -> Column:
    """Whether a pair's sizes and signatures allow the similarity; ``n, bits`` and ``other_*``."""
    # A set can only be similar to one of at least percent / 100 of its size.
    sizes = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
    words = -(-_BITS // 64)
    differing = F.expr(" + ".join(f"bit_count(bits[{i}] ^ other_bits[{i}])" for i in range(words)))
    return sizes & (differing <= _most_differing(percent))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of a whole text.

    Only A-Z are lower-cased. Fewer words make one shingle of them all; no word makes none.
    """
    words = _WORD.findall((text or "").encode("utf-8", "replace").lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.array(sorted(map(xxhash.xxh3_64_intdigest, set(parts))), dtype=np.uint64)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    draw = random.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    return draw[0], draw[1]


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over a set.

    Multiply, add and shift: the upper half of ``a x + b`` modulo 2^64, for x of 32 bits.
    """
    x = hashes >> np.uint64(32)
    least = np.full(len(a), np.iinfo(np.uint64).max)
    for start in range(0, len(x), 256):
        values = np.multiply.outer(a, x[start : start + 256])
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least >> np.uint64(32)


def _packed(least: np.ndarray) -> np.ndarray:
    """The lowest bit of every minimum, 64 to a number."""
    bits = np.packbits((least & np.uint64(1)).astype(np.uint8))
    return np.pad(bits, (0, -len(bits) % 8)).view("<i8")


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    a, b = _multipliers()
    numbers = np.arange(BANDS, dtype="<u8")[:, None]
    schema = pa.schema([
        ("id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()),
        ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())),
    ])
    for batch in batches:
        rows: list[list] = [[] for _ in schema]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = shingles(text, width)
            if len(own):
                least = minima(own, a, b)
                keyed = np.hstack([numbers, least.astype("<u8").reshape(BANDS, ROWS)])
                bands = np.array([xxhash.xxh3_64_intdigest(k.tobytes()) for k in keyed], dtype=np.uint64)
                values = (
                    doc_id, len(own), xxhash.xxh3_128_digest(own.tobytes()),
                    bands.view(np.int64), _packed(least),
                )
            else:
                values = (doc_id, 0, None, None, None)
            for column, value in zip(rows, values):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])
    for batch in batches:
        found = [shingles(t, width).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=schema)


def _share(one: bytes, other: bytes) -> tuple[int, int]:
    a, b = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
    both = np.intersect1d(a, b, assume_unique=True).size
    return both, a.size + b.size - both


def _similar(percent: int):
    @F.pandas_udf("boolean")
    def similar(one: pd.Series, other: pd.Series) -> pd.Series:
        pairs = (_share(a, b) for a, b in zip(one, other))
        return pd.Series([100 * both >= percent * union for both, union in pairs], dtype=bool)

    return similar


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are similar. Only their texts are read again."""
    pairs = staged(pairs, "pairs")
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    sets = docs.join(wanted, "id", "left_semi").mapInArrow(partial(_sets, width=width), "id bigint, hashes binary")
    similar = _similar(percent)
    return (
        pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")), "u")
        .join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v")
        .where(similar("a", "b")).select("u", "v")
    )


def near_duplicates(docs: DataFrame, width: int, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Documents with ``100 * intersection >= percent * union`` are linked; ``component_id`` is
    the smallest doc_id reachable. An empty, blank or null text has no shingle and no link.
    Rows that share a doc_id are one document, linked with all that any of them is linked
    with. A row without a doc_id cannot be reached: it comes back kept, other columns null.
    """
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), "text")
    signed = staged(named.mapInArrow(partial(_sign, width=width), _SIGNED), "signatures")
    filled = signed.where("n > 0")
    classes = staged(
        filled.groupBy("class").agg(F.min("id").alias("head"), F.first("n").alias("n"), F.first("bits").alias("bits")),
        "classes",
    )
    members = staged(filled.select("id", "class").join(classes.select("class", "head"), "class").select("id", "head"), "members")
    # The rows of a class have the same bands; those of its first row serve.
    firsts = filled.join(classes.select("class", F.col("head").alias("id")), ["class", "id"], "left_semi")
    banded = firsts.select("id", F.explode("bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.min("id").alias("other"), F.max("id").alias("last"))
    shared = staged(shared.where("other != last").select("band", "other"), "shared_bands")
    buckets = staged(banded.join(shared, "band"), "buckets")
    heads = classes.select(F.col("head").alias("id"), "n", "bits")

    settle = partial(_settled, docs=named, width=width, percent=percent)
    first = buckets.where("id != other").select(F.col("id").alias("u"), F.col("other").alias("v"))
    reached = settle(_promising(first, heads, percent), None)
    opened = buckets.select("band", "id")
    for draw in range(DRAWS):
        opened = _open_buckets(opened, reached)
        reached = settle(_promising(_drawn_pairs(opened, draw), heads, percent), reached)
    opened = _open_buckets(opened, reached).join(heads, "id")
    reached = settle(_other_pairs(opened, percent), reached)

    own = members.join(reached.withColumnRenamed("node", "head"), "head", "left").select(
        "id", F.coalesce("component", "head").alias("component")
    )
    # An id with several texts is in the components of all of them.
    several = own.groupBy("id").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u != v")
    own = own.groupBy("id").agg(F.min("component").alias("node"))
    own = own.join(_map(components(several.select("u", "v"))), "node", "left").select(
        "id", F.coalesce("component", "node").alias("component")
    )
    known = signed.select("id", "n").join(own, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_shingles"),
        F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"),
    )
    return known.union(nameless)


def _map(found: DataFrame) -> DataFrame:
    return found.select("node", "component")


def _promising(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose sizes and signatures are alike, with the bands they share."""
    counted = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    ours = heads.select(F.col("id").alias("u"), "n", "bits")
    theirs = heads.select(F.col("id").alias("v"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"))
    return counted.join(ours, "u").join(theirs, "v").where(_alike(percent)).select("u", "v", "shared")


def _apart(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with these."""
    pairs = pairs.select("u", "v", "shared")
    for end in ("u", "v"):
        found = merged.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        pairs = pairs.join(found, end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    return pairs.where("u_in != v_in")


def _settled(
    pairs: DataFrame, merged: DataFrame | None, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """The components after all of ``pairs (u, v, shared)`` are compared or in one component.

    Each u is compared with the v it shares most bands with, then each two components by the pair
    that shares most bands between them. The members of a group of copies are in one component
    after that; all pairs that are still apart are compared last.
    """
    left = staged(pairs, "candidates")
    best = left.groupBy("u").agg(F.max(F.struct("shared", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    for _ in range(2):
        best = staged(best, "best")
        merged = staged(_joined(merged, _verified(best, docs, width, percent)), "merged")
        left = staged(_apart(left.join(best, ["u", "v"], "left_anti"), merged), "apart")
        between = left.groupBy(F.least("u_in", "v_in").alias("x"), F.greatest("u_in", "v_in").alias("y"))
        best = between.agg(F.max(F.struct("shared", "u", "v")).alias("best")).select("best.u", "best.v")
    return staged(_joined(merged, _verified(left.select("u", "v"), docs, width, percent)), "merged")


def _open_buckets(buckets: DataFrame, merged: DataFrame) -> DataFrame:
    """The members of buckets with several components, and their largest component."""
    grouped = buckets.select("id", "band").join(merged.withColumnRenamed("node", "id"), "id", "left")
    grouped = staged(grouped.withColumn("component", F.coalesce("component", "id")), "grouped")
    sizes = grouped.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("band").agg(
        F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts")
    )
    largest = staged(largest.where("parts > 1").select("band", F.col("top.component").alias("top")), "largest")
    return staged(grouped.join(largest, "band"), "open_buckets")


def _drawn_pairs(opened: DataFrame, draw: int) -> DataFrame:
    """Every class with a member of each of its open buckets that the band's hash draws."""
    order = F.struct(F.xxhash64("band", "id", F.lit(draw)), "id", "component")
    drawn = opened.groupBy("band").agg(F.min(order).alias("drawn"))
    drawn = staged(drawn.select("band", F.col("drawn.id").alias("other"), F.col("drawn.component").alias("other_in")), "drawn")
    return opened.join(drawn, "band").where("component != other_in").select(
        F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")
    )


def _other_pairs(opened: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components, with the bands they share. One end is outside
    the largest."""
    outside = opened.where("component != top").select(
        "band", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"),
        F.col("component").alias("other_in"),
    )
    once = (F.col("component") == F.col("top")) | (F.col("id") < F.col("other"))
    found = opened.join(outside, "band").where(_alike(percent) & (F.col("component") != F.col("other_in")) & once)
    return found.groupBy(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).agg(
        F.count(F.lit(1)).alias("shared")
    )


def _joined(merged: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``merged``, none at first, with further links between them."""
    if merged is None:
        return components(links)
    named = links
    for end in ("u", "v"):
        found = merged.select(F.col("node").alias(end), F.col("component").alias("found"))
        named = named.join(found, end, "left").withColumn(end, F.coalesce("found", end)).drop("found")
    above = staged(components(named), "above")
    lifted = merged.join(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    known = lifted.select("node", F.coalesce("top", "component").alias("component"))
    return known.union(above.select("node", "component")).groupBy("node").agg(F.min("component").alias("component"))


def without_near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, before: DataFrame | None = None
) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each group; columns stay.

    Rows that repeat both id and text are one document and leave one row, null ids and texts
    included. Rows without an id are linked with nothing else, so their other near copies stay.
    With ``before``, the rows as they were before passages were cut out of them, near copies
    of which only a rest is left are found by their whole texts as well.
    """
    texts = docs.select("doc_id", "text")
    if before is not None:
        now = texts.groupBy("doc_id").agg(F.collect_set(F.xxhash64("text")).alias("now"))
        changed = ~F.array_contains("now", F.xxhash64("text"))
        texts = texts.union(before.select("doc_id", "text").join(now, "doc_id").where(changed).select("doc_id", "text"))
    found = near_duplicates(texts, width, percent)
    gone = found.where(~F.col("kept")).select("doc_id")
    once = docs.dropDuplicates(["doc_id", "text"])
    return once.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
