"""Two tokenizers' ids for the same text, aligned by the bytes they cover.

A and B encode the same bytes. The ends of A's tokens, as running sums of their lengths, go
into a dictionary from end to index, and so do B's; the sorted intersection of the two key sets
cuts both id lists into groups, the smallest slices that cover the same bytes. Within a slice
every pair of tokens whose byte ranges overlap is a link.

Both tokenizers cut before a space or line end that follows something else (checked against the
files), and between a letter and a clause mark, so these places are common ends for certain:
the dictionaries are built per part between them, and as parts repeat, as words do, each worker
remembers those it has aligned.

The corpus then says how often each pair of ids is linked. Texts are taken in chunks of
bounded size. A chunk lists each of its pairs once, with its count; these lists are summed by
pair, and every chunk gets back the sums of its own pairs only. So the frequent pairs cost one
row a chunk, and no table of all pairs is broadcast or collected.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagelens.session import staging_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Characters of text in a chunk, and in one call of a tokenizer. A chunk is at least one text.
CHUNK_CHARS = 4_000_000
CALL_CHARS = 500_000
# Parts a worker remembers, and the longest it does, in characters.
MEMORY = 250_000
LONGEST = 64
_B_BITS = 32
# Letters of Latin and Cyrillic words, and marks that end or part clauses: between the two both
# tokenizers cut (in A letters and marks are pieces of their own; B's vocabulary is checked).
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u04ff"
_MARKS = ".,;:!?"
_MARKED = re.compile(f"[{_LETTERS}][{_MARKS}]")
# A plain word with the space or line end before it; marks behind a letter; else white space and
# what follows it up to the next space or line end. The model's own mark for a space counts as
# white space: behind it nothing is cut.
_PART = re.compile(
    f"[ \n][{_LETTERS}]+(?=[{_MARKS} \n]|$)|(?<=[{_LETTERS}])[{_MARKS}]+(?=[ \n]|$)"
    "|[\\s▁]*[^\\s▁]*(?:(?![ \n])[\\s▁]+[^\\s▁]*)*"
)


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A tokenizers file of byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        entries: dict[str, int] = spec["model"]["vocab"]
        split = spec["pre_tokenizer"] or {}
        # The library's own split never joins white space to what stands before it.
        self.cuts = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        alphabet = _byte_alphabet()
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = (
                bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
            )

    def encode(self, parts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(list(parts), add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before every text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._library = SentencePieceProcessor(model_file=path)
        numbers = range(self._library.get_piece_size())
        self.bytes = [self._spelled(i) for i in numbers]
        # No piece has a space behind something else, holds a line end, or has a mark behind a
        # letter; and unknown characters are bytes.
        written = [self._library.id_to_piece(i) for i in numbers if not self._library.is_byte(i)]
        across = any(re.search("[^▁]▁|\n", p) or _MARKED.search(p) for p in written)
        self.cuts = any(map(self._library.is_byte, numbers)) and not across
        self.cuts = self.cuts and self._library.encode("Ａ\nb") == [
            *self._library.encode("Ａ"), *self._library.encode("\nb")[1:]
        ]
        self._mark = len(self._library.encode("\n"))

    def _spelled(self, i: int) -> bytes:
        piece = self._library.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self._library.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, parts: Sequence[str], cut: bool) -> list[list[int]]:
        """The ids of parts of a text, or of whole texts, which begin with the space it adds."""
        if cut:
            # Behind a line end the model adds no space of its own.
            return [ids[self._mark :] for ids in self._library.encode(["\n" + p for p in parts], num_threads=1)]
        return self._library.encode([p[1:] for p in parts], num_threads=1)


def links_of(a: Sequence[int], b: Sequence[int], a_bytes: Sequence[bytes], b_bytes: Sequence[bytes]) -> list[tuple[int, int]]:
    """The pairs of a slice (two lists over the same bytes) whose byte ranges overlap, in order."""
    if len(a) == 1 or len(b) == 1:
        return [(x, y) for x in a for y in b]
    pairs, i, j = [], 0, 0
    end_a, end_b = len(a_bytes[a[0]]), len(b_bytes[b[0]])
    while True:
        pairs.append((a[i], b[j]))
        on_a, on_b = end_a <= end_b, end_b <= end_a
        if on_a:
            i += 1
        if on_b:
            j += 1
        if i == len(a) or j == len(b):
            return pairs
        if on_a:
            end_a += len(a_bytes[a[i]])
        if on_b:
            end_b += len(b_bytes[b[j]])


class Part(NamedTuple):
    """An aligned part: its numbers of ids and groups, its groups as text, its links as pair codes."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    codes: bytes


class Aligner:
    """One a worker process."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.cuts = self.a.cuts and self.b.cuts
        self._a_size = list(map(len, self.a.bytes))
        self._b_size = list(map(len, self.b.bytes))
        # What was used lately, and what was used before that.
        self._known: dict[str, Part | None] = {}
        self._older: dict[str, Part | None] = {}

    def parts(self, text: str) -> list[str]:
        # The pattern also matches nothing, at the end.
        return _PART.findall(" " + text)[:-1] if self.cuts else [" " + text]

    def align(self, texts: Sequence[str]) -> list[list[Part] | None]:
        """Each text's aligned parts; None where one tokenizer does not give back its bytes."""
        split = list(map(self.parts, texts))
        if len(self._known) > MEMORY // 2:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        fresh = set(chain.from_iterable(split)).difference(known)
        known.update((p, older[p]) for p in fresh if p in older)
        missing = [p for p in fresh if p not in older]
        known.update(zip(missing, self._aligned(missing)))
        out = [list(map(known.__getitem__, parts)) for parts in split]
        for part in missing:
            if len(part) > LONGEST:
                del known[part]
        return [None if None in parts else parts for parts in out]

    def _aligned(self, parts: list[str]) -> Iterator[Part | None]:
        """The parts aligned, in their order."""
        # Parts that begin and end as words do can stand behind each other in one call of A's library.
        plain = [p for p in parts if p[0] in " \n" and not p[-1].isspace() and "▁" not in p] if self.cuts else []
        text = "".join(plain)
        ends = np.cumsum([len(p.encode()) for p in plain])
        a = dict(zip(plain, _sliced(self.a.encode([text])[0], self._a_size, ends) if plain else []))
        others = [p for p in parts if p not in a]
        a.update(zip(others, self.a.encode(others)))
        for part, y in zip(parts, self.b.encode(parts, self.cuts) if parts else []):
            x = a[part]
            same = self._given_back(part, x, self.a) and self._given_back(part, y, self.b)
            yield self.part(x, y) if same else None

    @staticmethod
    def _given_back(text: str, ids: Iterable[int], tokenizer: ByteLevel | Pieces) -> bool:
        return b"".join(map(tokenizer.bytes.__getitem__, ids)) == text.encode()

    def part(self, a: list[int], b: list[int]) -> Part:
        """Both lists, cut where a token of A and one of B end at the same byte."""
        if len(a) == len(b) == 1:
            return Part(1, 1, 1, f"{a[0]}|{b[0]}", _PACKED(a[0] << _B_BITS | b[0]))
        ends_a, ends_b = _ends(a, self._a_size), _ends(b, self._b_size)
        lines, codes, i, k = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            j, m = ends_a[end], ends_b[end]
            if j - i == m - k == 1:
                lines.append(f"{a[i]}|{b[k]}")
                codes.append(a[i] << _B_BITS | b[k])
            else:
                x, y = a[i:j], b[k:m]
                lines.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
                codes += [p << _B_BITS | q for p, q in links_of(x, y, self.a.bytes, self.b.bytes)]
            i, k = j, m
        return Part(len(a), len(b), len(lines), ";".join(lines), array("q", codes).tobytes())


_PACKED = struct.Struct("=q").pack


def _ends(ids: list[int], size: list[int]) -> dict[int, int]:
    """From each token's end, in bytes, to how many tokens end there or before."""
    ends, at = {}, 0
    for n, i in enumerate(ids, 1):
        at += size[i]
        ends[at] = n
    return ends


def _sliced(ids: list[int], size: list[int], ends: np.ndarray) -> list[list[int]]:
    """The ids of texts that were encoded behind each other and end at these bytes; none if a token
    reaches across an end."""
    found = np.cumsum(np.array(size)[ids])
    at = np.searchsorted(found, ends) + 1
    if at[-1] != len(ids) or (found[at - 1] != ends).any():
        return []
    cuts = [0, *at.tolist()]
    return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# A chunk: its documents, where each one's links lie in ``links``, and its pairs with their counts.
_DOC = pa.struct([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_pairs", pa.int64()), ("groups_sha256", pa.string()),
])
_PAIR = pa.struct([("code", pa.int64()), ("n", pa.int64())])
_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("docs", pa.list_(_DOC)), ("links", pa.binary()), ("pairs", pa.list_(_PAIR)),
])
_CHUNK_SQL = (
    "chunk bigint, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint,"
    " n_pairs: bigint, groups_sha256: string>>, links binary, pairs array<struct<code: bigint, n: bigint>>"
)


class _Chunk:
    """Documents under way to one row. A document's links are (pair, times); pairs are numbered
    when the chunk is complete."""

    def __init__(self):
        self.docs: list[dict] = []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, parts: list[Part] | None) -> None:
        parts = parts or []
        n_a, n_b, n_groups, groups, codes = zip(*parts) if parts else ((), (), (), (), ())
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if parts else ""
        links = np.frombuffer(b"".join(codes), "<i8")
        pairs, times = np.unique(links, return_counts=True)
        self.codes.append(pairs)
        self.times.append(times)
        self.docs.append({
            "doc_id": doc_id, "n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups),
            "n_links": len(links), "n_pairs": len(pairs), "groups_sha256": digest,
        })

    def row(self, number: int) -> pa.RecordBatch:
        times = np.concatenate(self.times)
        codes, index = np.unique(np.concatenate(self.codes), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, index, times)
        links = np.stack([index, times]).astype("<u4").tobytes()
        pairs = pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], fields=list(_PAIR))
        arrays = [pa.array([v], f.type) for v, f in zip((number, self.docs, links), _CHUNK)]
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pairs))
        return pa.RecordBatch.from_arrays(arrays, schema=_CHUNK)


def _calls(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """The batch's rows, some texts at a time; a null text is an empty one."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(doc_id)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _chunks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, chunk_chars: int) -> Iterator[pa.RecordBatch]:
    known, chunk = aligner(a_path, b_path), _Chunk()
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for ids, texts in _calls(batch, min(CALL_CHARS, chunk_chars)):
            full = [t for t in texts if t]
            aligned = iter(known.align(full))
            for doc_id, text in zip(ids, texts):
                chunk.add(doc_id, next(aligned) if text else None)
                chunk.chars += len(text)
            if chunk.chars >= chunk_chars:
                yield chunk.row(number)
                chunk, number = _Chunk(), number + 1
    if chunk.docs:
        yield chunk.row(number)


_RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,"
    " groups_sha256 string"
)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's links against its chunk's sums, which come as (code, count, best) per pair."""
    for batch in batches:
        for row in range(batch.num_rows):
            # Only this row's lists are turned into Python objects or arrays.
            docs = batch.column("docs")[row].as_py()
            pairs = batch.column("pairs")[row].values
            codes = pairs.field("code").to_numpy() if pairs is not None else np.empty(0, np.int64)
            sums = batch.column("sums")[row].values
            counts, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
            if sums is not None and len(sums):
                found = sums.field("code").to_numpy()
                order = np.argsort(found)
                at = order[np.searchsorted(found, codes, sorter=order)]
                counts = sums.field("n").to_numpy()[at]
                best = sums.field("best").to_numpy(zero_copy_only=False).astype(np.int64)[at]
            index, times = np.frombuffer(batch.column("links")[row].as_py(), "<u4").reshape(2, -1).astype(np.int64)
            ends = np.cumsum([d["n_pairs"] for d in docs])

            def per_document(values: np.ndarray) -> pa.Array:
                running = np.concatenate([[0], np.cumsum(values)])
                return pa.array(np.diff(running[np.concatenate([[0], ends])]), pa.int64())

            columns = {name: [d[name] for d in docs] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            arrays = [pa.array(c, pa.int64()) for c in columns.values()]
            arrays += [per_document(best[index] * times), per_document(counts[index] * times)]
            arrays.append(pa.array([d["groups_sha256"] for d in docs], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _RESULT.split(", ")])


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of aligned documents, written to the shared staging folder and read from there."""
    spark = docs.sparkSession
    path = staging_path(spark, "aligned")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    align = partial(_chunks, a_path=a_path, b_path=b_path, chunk_chars=chunk_chars)
    rows.mapInArrow(align, _CHUNK_SQL).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_CHUNK_SQL).parquet(path)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``a, b, n, best`` for every pair of ids that the corpus links: how many links hold it, and
    whether none with this B holds more. ``code`` is the pair as one number."""
    listed = chunks.select(F.explode("pairs").alias("pair")).select("pair.code", "pair.n")
    counted = listed.groupBy("code").agg(F.sum("n").alias("n"))
    b = F.col("code").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", b).join(most, "b").select(
        "code", F.shiftright("code", _B_BITS).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best")
    )


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    A is a byte-level tokenizers file, given a space and the text; B a sentencepiece model, given
    the text. ``n_best`` are the links whose pair has the most links its B id has with any A id,
    ties included; ``count_sum`` adds up the corpus-wide counts of all links. A null or empty
    text, and one whose bytes either tokenizer does not give back, has no tokens: zeros and an
    empty text for the checksum. Rows that repeat an id, or have none, each have their own row
    and all count.
    """
    chunks = aligned_chunks(docs, a_path, b_path, chunk_chars)
    counts = pair_counts(chunks).select("code", "n", "best")
    wanted = chunks.select("chunk", F.explode("pairs.code").alias("code"))
    # At most a chunk's own pairs come back to it.
    sums = wanted.join(counts, "code").groupBy("chunk").agg(F.collect_list(F.struct("code", "n", "best")).alias("sums"))
    return chunks.join(sums, "chunk", "left").select("docs", "pairs", "links", "sums").mapInArrow(_scored, _RESULT)
