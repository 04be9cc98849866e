"""Repeated passages, found by winnowing and deleted but for their first place.

A passage is a stretch of at least ``passage_words`` words; it may start and end inside a line.
Its windows of exactly that many words each pick, as fingerprint, the smallest hash of the
seeds (half as many words) inside them; equal windows pick the same.

Neighbouring windows that pick the same place are a unit: all the words that they cover. The
places are chosen by content, so a passage that stands elsewhere is cut into the same units
there, but for its ends. Units are joined to the first place of an equal one and are settled
as a whole where it is earlier, one row for about a fifth of a window's words. Of the others,
first places and the ends of passages, those that share their fingerprint are taken apart, and
their windows compared one by one, by 128 bits of their words. Overlapping repeated windows
make up a passage as far as it goes to both sides. What results is exact up to those hashes: a
word goes if and only if it lies in a passage that stands, complete, in an earlier place. (A
window's first place is never in a settled unit: the unit that settled it stands earlier.)

With ``run_words`` below ``passage_words``, runs of whole lines of at least ``run_words`` words
go as well. The smallest runs that reach this size, forwards from a line or backwards from it,
are their windows, and the line with the smallest hash is the fingerprint.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wagelens.llm.tables import free_name, row_key
from wagelens.session import staged

RUN_WORDS = 50
_BATCH_ROWS = 1 << 15
# Odd, so that they have inverses modulo 2^64.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"\S+")
_UNIT = "start: int, n: int, seed: bigint, run: bigint, run2: bigint"
_UNITS = f"key binary, doc_id bigint, tag bigint, units array<struct<{_UNIT}>>"
_SINGLE = "doc_id bigint, tag bigint, start int, n int, run bigint, run2 bigint"
_WINDOWS = "key binary, doc_id bigint, first int, last int, spot int, fingerprint bigint, run binary"


def _lines(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """Numbers, word counts and contents' hashes of the lines with words."""
    numbers, words, hashes = [], [], []
    for number, line in enumerate(text.split("\n")):
        parts = line.split()
        if parts:
            numbers.append(number)
            words.append(len(parts))
            hashes.append(xxhash.xxh3_128_digest(" ".join(parts)))
    return numbers, words, hashes


def _windows(words: list[int], hashes: list[bytes], run_words: int) -> Iterator[tuple[int, int, int]]:
    spans = set()
    last, total = 0, 0
    for first in range(len(words)):
        while last < len(words) and total < run_words:
            total += words[last]
            last += 1
        if total < run_words:
            break
        spans.add((first, last - 1))
        total -= words[first]
    first, total = len(words) - 1, 0
    for last in range(len(words) - 1, -1, -1):
        while first >= 0 and total < run_words:
            total += words[first]
            first -= 1
        if total < run_words:
            break
        spans.add((first + 1, last))
        total -= words[last]
    for first, last in sorted(spans):
        yield first, last, min(range(first, last + 1), key=lambda i: (hashes[i], -i))


def _window_rows(batches: Iterator[pa.RecordBatch], run_words: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("key", pa.binary()), ("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
        ("spot", pa.int32()), ("fingerprint", pa.int64()), ("run", pa.binary()),
    ])
    for batch in batches:
        rows: list[list] = [[] for _ in schema]
        for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            numbers, words, hashes = _lines(text or "")
            for first, last, spot in _windows(words, hashes, run_words):
                run = xxhash.xxh3_128_digest(b"".join(hashes[first : last + 1]))
                mark = int.from_bytes(hashes[spot][:8], "little", signed=True)
                for values, value in zip(rows, (key, doc_id, numbers[first], numbers[last], spot, mark, run)):
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``key, first, last``: the runs, by line numbers, that an earlier place holds already.

    Places are ordered by doc_id (null first), then by key and line. A run that overlaps its
    own first place in the same text is no repetition. Rows that repeat a whole row, id and
    text, share a key and count as one.
    """
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("bigint"), "text")
    found = rows.mapInArrow(partial(_window_rows, run_words=run_words), _WINDOWS)
    place = F.struct("doc_id", "key", "spot")
    shared = (
        found.groupBy("fingerprint").agg(F.min(place).alias("one"), F.max(place).alias("other"))
        .where(F.col("one") != F.col("other")).select("fingerprint")
    )
    candidates = found.join(shared, "fingerprint").select("key", "doc_id", "first", "last", "run")
    origin = candidates.groupBy("run").agg(F.min(F.struct("doc_id", "key", "first", "last")).alias("origin"))
    same_row = F.col("key") == F.col("origin.key")
    return (
        candidates.join(origin, "run")
        .where(~same_row | (F.col("first") > F.col("origin.last")))
        .select("key", "first", "last")
    )


def _mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(factor: int, size: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(size - 1, factor, dtype=np.uint64).cumprod()])


def _powers_of(factor: int, count: int) -> np.ndarray:
    """The first powers of a number modulo 2^64, kept in sizes that double."""
    return _powers(factor % (1 << 64), max(4096, 1 << (count - 1).bit_length()))[:count]


def _word_hashes(text: str) -> np.ndarray:
    """128 bits a word, in two columns: polynomials of its bytes, mixed with its length.

    All words of a text at once, from running sums over its bytes.
    """
    raw = np.frombuffer(" ".join(text.split()).encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.empty((0, 2), np.uint64)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    values = raw.astype(np.uint64) + np.uint64(1)
    columns = []
    for factor in _FACTORS:
        sums = np.concatenate([np.zeros(1, np.uint64), (values * _powers_of(factor, len(raw))).cumsum()])
        back = _powers_of(pow(factor, -1, 1 << 64), len(raw))[starts]
        columns.append(_mixed((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64)))
    return np.stack(columns, axis=1)


def _stretches(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """Hashes of stretches of words: polynomials in ``factor`` modulo 2^64, mixed with their lengths."""
    powers = _powers_of(factor, len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), (hashes * powers).cumsum()])
    back = _powers_of(pow(factor, -1, 1 << 64), len(hashes))[starts]
    return _mixed((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64)).view(np.int64)


def _rolling(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hashes of all stretches of ``width`` words: polynomials in ``factor`` modulo 2^64."""
    sums = np.concatenate([np.zeros(1, np.uint64), (hashes * _powers_of(factor, len(hashes))).cumsum()])
    return (sums[width:] - sums[:-width]) * _powers_of(pow(factor, -1, 1 << 64), len(hashes) - width + 1)


def _fingerprints(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds, and for every window of ``width`` words its fingerprint's place."""
    seed = (width + 1) // 2
    seeds = _rolling(hashes[:, 0], seed, _FACTORS[0])
    # Mixed, for a polynomial's order says something about its words.
    seeds = _mixed(seeds)
    spots, reach, wanted = np.arange(len(seeds)), 1, width - seed + 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        left, right = spots[:-step], spots[step:]
        spots = np.where(seeds[left] <= seeds[right], left, right)
        reach += step
    return seeds.view(np.int64), spots


def _batched(tables: Iterator[list[pa.Array]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many small tables in batches of about ``_BATCH_ROWS``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for arrays in tables:
        whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
        for at in range(0, whole.num_rows, _BATCH_ROWS):
            held.append(whole.slice(at, _BATCH_ROWS))
            rows += held[-1].num_rows
            if rows >= _BATCH_ROWS:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()


def _unit_starts(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every unit: those that pick the same place."""
    starts = np.flatnonzero(np.concatenate([[True], spots[1:] != spots[:-1]]))
    return starts, np.diff(np.append(starts, len(spots)))


def _runs(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """128 bits, in two columns, of the words that stretches of so many windows cover."""
    return [_stretches(hashes[:, i], starts, starts + sizes + width - 1, _FACTORS[i]) for i in range(2)]


def _unit_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row per text of at least ``width`` words, with its units."""
    fields = [pa.field(*f) for f in (
        ("start", pa.int32()), ("n", pa.int32()), ("seed", pa.int64()), ("run", pa.int64()), ("run2", pa.int64())
    )]
    for batch in batches:
        keys, ids, tags, columns, ends = [], [], [], [[] for _ in fields], [0]
        for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            hashes = _word_hashes(text or "")
            if len(hashes) < width:
                continue
            seeds, spots = _fingerprints(hashes, width)
            starts, sizes = _unit_starts(spots)
            for column, values in zip(columns, (starts, sizes, seeds[spots[starts]], *_runs(hashes, starts, sizes, width))):
                column.append(values)
            keys.append(key)
            ids.append(doc_id)
            tags.append(int.from_bytes(key[:8], "big") >> 1)
            ends.append(ends[-1] + len(starts))
        if keys:
            units = pa.StructArray.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, fields)], fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), units)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), lists],
                names=["key", "doc_id", "tag", "units"],
            )


def _window_stretches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of the units that are given with a text by their starts."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
        ("run", pa.int64()), ("run2", pa.int64()),
    ])

    def tables() -> Iterator[list[pa.Array]]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, tag = batch.column(0)[row], batch.column(1)[row]
                given = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
                hashes = _word_hashes(batch.column(2)[row].as_py())
                starts, sizes = _unit_starts(_fingerprints(hashes, width)[1])
                chosen = np.isin(starts, given)
                starts, sizes = starts[chosen], sizes[chosen]
                starts = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ones = np.ones(len(starts), np.int32)
                yield [
                    pa.repeat(doc_id, len(starts)), pa.repeat(tag, len(starts)), pa.array(starts, pa.int32()),
                    pa.array(ones), *map(pa.array, _runs(hashes, starts, ones, width)),
                ]

    return _batched(tables(), schema)


def _with_origin(stretches: DataFrame, width: int) -> DataFrame:
    """``stretches`` without their hashes, and whether an earlier place holds the same words already.

    A stretch that overlaps its own first place in the same text is not settled by it.
    """
    place = F.struct("doc_id", "tag", "start")
    origin = stretches.groupBy("run", "run2").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("times"))
    # Written, so that the join's sides are plain shuffles: adaptive execution splits the rows of a
    # passage that very many texts hold only then.
    origin = staged(origin.where("times > 1").drop("times"), "first_places")
    found = stretches.join(origin, ["run", "run2"], "left")
    same = (F.col("tag") == F.col("origin.tag")) & F.col("doc_id").eqNullSafe(F.col("origin.doc_id"))
    apart = F.col("origin").isNotNull() & (~same | (F.col("start") >= F.col("origin.start") + width))
    return found.withColumn("repeated", apart).drop("run", "run2", "origin")


def repeated_passages(docs: DataFrame, passage_words: int = RUN_WORDS) -> DataFrame:
    """``key, start, n``: so many neighbouring windows of ``passage_words`` words, by the number of
    the first one's first word, each of which an earlier place holds already.

    Places are ordered and repeated rows count as in ``repeated_runs``. Rows carry the doc_id and
    a tag, 63 bits of the key that tell texts of one id, or of none, apart and sort as the key.
    """
    width = passage_words
    key = row_key(F.col("doc_id"), F.col("text")).alias("key")
    rows = docs.select(key, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = staged(rows.mapInArrow(partial(_unit_rows, width=width), _UNITS), "passage_units")
    units = texts.select("doc_id", "tag", F.explode("units").alias("unit")).select("doc_id", "tag", "unit.*")
    units = staged(_with_origin(units, width), "settled_units")
    left = units.where("not repeated")
    # A fingerprint that no other unit left has cannot be that of an equal window.
    shared = left.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("seed")
    given = left.join(shared, "seed").groupBy("doc_id", "tag").agg(F.collect_set("start").alias("given"))
    names = texts.select("key", F.col("doc_id").alias("id"), F.col("tag").alias("mark"))
    ours = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("mark"))
    asked = given.join(names, ours).select("key", "doc_id", "tag", "given").dropDuplicates(["key"])
    single = rows.select("key", "text").join(asked, "key").select("doc_id", "tag", "text", "given").mapInArrow(
        partial(_window_stretches, width=width), _SINGLE
    )
    single = _with_origin(staged(single, "passage_windows"), width)
    found = units.drop("seed").union(single).where("repeated").select("doc_id", "tag", "start", "n")
    return found.join(names, ours).select("key", "start", "n")


def _left(text: str, runs: list, starts: list, width: int) -> str:
    """``text`` without the lines of ``runs`` and, for each (start, n) of ``starts``, the n windows of
    ``width`` words from there on."""
    lines = text.split("\n")
    counts = [len(line.split()) for line in lines]
    ends = np.cumsum([0, *counts])
    gone = np.zeros(ends[-1], dtype=bool)
    for first, last in runs:
        gone[ends[first] : ends[last + 1]] = True
    for start, n in starts:
        gone[start : start + n - 1 + width] = True
    kept, before = [], False
    for line, count, end in zip(lines, counts, ends[1:].tolist()):
        flags = gone[end - count : end]
        cut = int(flags.sum())
        # An empty line goes with the line before it.
        before = cut == count if count and cut else before and not count
        if before:
            continue
        if cut:
            pieces, last = [], -2
            spans = [m.span() for m in _WORD.finditer(line)]
            for i in np.flatnonzero(~flags).tolist():
                if i == last + 1:
                    pieces[-1][1] = spans[i][1]
                else:
                    pieces.append([spans[i][0] if i else 0, spans[i][1]])
                last = i
            if last == count - 1:
                pieces[-1][1] = len(line)
            line = " ".join(line[a:b] for a, b in pieces)
        kept.append(line)
    return "\n".join(kept)


def _cut(width: int) -> Callable[..., Column]:
    @F.pandas_udf(StringType())
    def cut(texts: pd.Series, runs: pd.Series, starts: pd.Series) -> pd.Series:
        rows = zip(texts, runs, starts)
        return pd.Series([t if t is None else _left(t, r, s, width) for t, r, s in rows], dtype=object)

    return cut


def without_repeated_lines(docs: DataFrame, run_words: int = RUN_WORDS, passage_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with later repeated passages and runs of lines cut out of ``text``; ``n_chars`` follows.

    Texts are compared by their words. A line of which words are left keeps these, with one
    space where others stood between; other lines stay as they are or go. Rows, their order of
    columns and extra columns stay; a null text stays null, and a text whose every word is
    repeated becomes empty.
    """
    key = free_name(docs.columns, "row_key")
    runs, starts = free_name(docs.columns, "repeated_runs"), free_name(docs.columns, "repeated_starts")
    span = F.array("first", "last")
    none = F.lit(None).cast("array<int>")
    found = repeated_passages(docs, passage_words).select("key", none.alias("span"), F.array("start", "n").alias("windows"))
    if run_words < passage_words:  # else passages hold them all
        found = found.union(repeated_runs(docs, run_words).select("key", span, none))
    cuts = found.groupBy(F.col("key").alias(key)).agg(
        F.collect_set("span").alias(runs), F.collect_set("windows").alias(starts)
    )
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(cuts, key, "left")
    affected = F.when(F.col(runs).isNotNull(), F.col("text"))
    cut = joined.withColumn("text", F.coalesce(_cut(passage_words)(affected, F.col(runs), F.col(starts)), F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn(
            "n_chars", F.when(F.col(runs).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
        )
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def unrepeated_documents(docs: DataFrame, run_words: int = RUN_WORDS, passage_words: int = RUN_WORDS) -> DataFrame:
    """As above, without the documents that had words and of which none is left."""
    key = free_name(docs.columns, "had_words")
    marked = docs.withColumn(key, F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    cut = without_repeated_lines(marked, run_words, passage_words)
    return cut.where(~F.col(key) | F.col("text").rlike(r"\S")).drop(key)


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, text_md5`` for every document.

    A null or empty text is one empty line, of which nothing is removed; its checksum is that
    of an empty text, as is that of a text whose every word is repeated.
    """
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = docs.select("doc_id", "text", lines.cast("bigint").alias("n_lines"), (F.length("text") > 0).alias("had_text"))
    left = F.when((F.col("text") == "") & F.col("had_text"), 0).otherwise(lines)
    return without_repeated_lines(rows).select(
        "doc_id",
        "n_lines",
        F.greatest(F.col("n_lines") - left, F.lit(0)).cast("bigint").alias("n_removed"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )
