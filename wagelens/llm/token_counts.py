"""Tokens per document, counted by a lookup in two tiers on the map side.

A text is cut where no token can reach across (forced boundaries, read off the vocabulary), so
its count is the sum of its pre-tokens' counts. Tier one is a compact table of frequent
pre-tokens and their counts, broadcast; tier two is what each worker remembers of the
pre-tokens it had to encode. No pre-token is ever shuffled, and a document's count needs its
own row alone: a lost executor costs the repetition of its tasks.

The table comes from a bounded sample (``SAMPLE_ROWS`` texts, ``SAMPLE_CHARS`` of each) and holds
at most ``TABLE`` pre-tokens of up to ``LONGEST`` characters, 4 MB at the most for plain letters.
It decides how much is encoded again, never a count.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LIMIT = 4_096
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 16_384
TABLE = 32_768
LONGEST = 32
# Pre-tokens a worker remembers, and the longest it does.
MEMORY = 300_000
_SPACE = "▁"
_CLASSES = 6


class Pieces:
    """A sentencepiece model: white space joins what follows it, letters join letters, and so on.

    Two characters that stand side by side in no piece are never merged. Characters that do
    form classes (union of all such pairs); a text is cut wherever the class changes, before
    white space and around characters that no longer piece holds. Cutting needs a model that
    takes characters as they are and spells unknown ones as bytes; a text of any other model
    is one pre-token.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        self._mark = len(self._model.encode("\n"))
        self._pattern = self._boundaries()

    def _boundaries(self) -> re.Pattern | None:
        model = self._model
        numbers = range(model.get_piece_size())
        if not any(map(model.is_byte, numbers)):
            return None
        parent: dict[str, str] = {}

        def root(c: str) -> str:
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        for i in numbers:
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            rest = model.id_to_piece(i).lstrip(_SPACE)
            if _SPACE in rest or (len(rest) > 1 and "\n" in rest):
                return None
            for a, b in zip(rest, rest[1:]):
                parent[root(a)] = root(b)
        classes: dict[str, list[str]] = {}
        for c in parent:
            classes.setdefault(root(c), []).append(c)
        joined = sorted((c for c in classes.values() if len(c) > 1), key=len, reverse=True)
        # Classes put together only cut less.
        joined = joined[:_CLASSES] + [[c for cs in joined[_CLASSES:] for c in cs]]
        runs = "|".join(f"[{re.escape(''.join(cs))}]+" for cs in joined if cs)
        pattern = re.compile(f" *(?:{runs + '|' if runs else ''}[^ ])| +", re.DOTALL)
        probe = "Ab  c,d\n\n e１　½fiﬁ İ\t1 23 .x \U0001f600"
        parts = pattern.findall(" " + probe)
        return pattern if sum(self._counted(parts)) == len(self._model.encode(probe)) else None

    def split(self, text: str) -> list[str]:
        if self._pattern is None:
            return [text]
        return self._pattern.findall(" " + text.replace(_SPACE, " ")) if text else []

    def count(self, parts: list[str]) -> list[int]:
        if self._pattern is None:
            return [len(ids) for ids in self._model.encode(parts, num_threads=1)]
        return self._counted(parts)

    def _counted(self, parts: list[str]) -> list[int]:
        # Behind a line end, at which every text is cut, the model adds no space of its own.
        ids = self._model.encode(["\n" + p for p in parts], num_threads=1)
        return [len(i) - self._mark for i in ids]


class Words:
    """A tokenizer file: its own normal form, split and merges; added tokens found in a text are
    the library's default, so a text that holds the string of one is one pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._added = [t.content for t in self._whole.get_added_tokens_decoder().values()]

    def split(self, text: str) -> list[str]:
        # A mark tells a whole text from a piece in the vocabulary's alphabet.
        if self._whole.pre_tokenizer is None or any(a in text for a in self._added):
            return ["\0" + text]
        if self._whole.normalizer is not None:
            text = self._whole.normalizer.normalize_str(text)
            if any(a in text for a in self._added):
                return ["\0" + text]
        return [piece for piece, _ in self._whole.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, parts: list[str]) -> list[int]:
        whole, model = self._whole, self._whole.model
        return [
            len(whole.encode(p[1:], add_special_tokens=False).ids) if p[:1] == "\0" else len(model.tokenize(p))
            for p in parts
        ]


@lru_cache(maxsize=4)
def splitter(path: str) -> Pieces | Words:
    """One a worker process."""
    return Words(path) if path.endswith(".json") else Pieces(path)


class Counts:
    """The two tiers. ``frequent`` is never changed; the own tier starts anew when it is full."""

    def __init__(self, cut: Pieces | Words, frequent: dict[str, int], memory: int = MEMORY):
        self._cut, self._frequent, self._memory = cut, frequent, memory
        self._own: dict[str, int] = {}

    def of(self, texts: Iterable[str | None]) -> Iterator[int]:
        """Each text's tokens; a null text has none. Misses are encoded a few texts at a time."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self._cut.split(text) if text else [])
            size += len(held[-1])
            if size >= 100_000:
                yield from self._sums(held)
                held, size = [], 0
        yield from self._sums(held)

    def _sums(self, texts: list[list[str]]) -> Iterator[int]:
        if len(self._own) > self._memory:
            self._own.clear()
        frequent, own = self._frequent.get, self._own
        fresh: dict[str, int] = {}
        sums, open_parts = [], []
        for parts in texts:
            found = list(map(frequent, parts))
            rare = [p for p, n in zip(parts, found) if n is None] if None in found else []
            missing = [p for p in rare if p not in own]
            fresh.update(dict.fromkeys(missing, 0))
            sums.append(sum(filter(None, found)))
            open_parts.append(rare)
        for p, n in zip(fresh, self._cut.count(list(fresh)) if fresh else []):
            fresh[p] = n
        for total, rare in zip(sums, open_parts):
            yield total + sum(fresh[p] if p in fresh else own[p] for p in rare)
        own.update((p, n) for p, n in fresh.items() if len(p) <= 4 * LONGEST)


def frequent_counts(texts: Iterable[str | None], path: str, table: int = TABLE) -> dict[str, int]:
    """The commonest pre-tokens of a sample, with their tokens."""
    cut = splitter(path)
    seen: Counter[str] = Counter()
    for text in texts:
        seen.update(cut.split(text) if text else [])
    short = {p: n for p, n in seen.items() if len(p) <= LONGEST}
    chosen = sorted(short, key=lambda p: (-short[p], p))[:table]
    return dict(zip(chosen, cut.count(chosen))) if chosen else {}


def _packed(counts: dict[str, int]) -> pa.RecordBatch:
    """The table as two Arrow columns: the bytes of its strings and a small integer each."""
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int32())], names=["part", "n"]
    )


# A worker's two tiers for the table in use; they serve all of the worker's tasks.
_in_use: dict[str, Counts] = {}


def _count_rows(
    batches: Iterator[pa.RecordBatch], path: str, shared: Broadcast, name: str, limit: int, memory: int
) -> Iterator[pa.RecordBatch]:
    if name not in _in_use:
        _in_use.clear()
        table = shared.value
        frequent = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
        _in_use[name] = Counts(splitter(path), frequent, memory)
    counts = _in_use[name]
    for batch in batches:
        n_tokens = list(counts.of(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(n_tokens, pa.int64()),
                pa.array([n > limit for n in n_tokens], pa.bool_()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def counted_documents(
    docs: DataFrame, path: str, limit: int = LIMIT, sample_rows: int = SAMPLE_ROWS, memory: int = MEMORY
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs (doc_id, text)``.

    ``n_tokens`` is what the library of the file at ``path`` gives for the whole text: tokenizers
    for ``.json``, sentencepiece for ``.model``; nothing is added before or behind it. A null or
    empty text has no bytes and no tokens. Rows that repeat an id, or have none, each have
    their own row in the result. ``over_limit`` is true beyond ``limit`` tokens.
    """
    spark = docs.sparkSession
    sample = docs.select(F.substring("text", 1, SAMPLE_CHARS)).take(sample_rows)
    table = _packed(frequent_counts((row[0] for row in sample), path))
    shared = spark.sparkContext.broadcast(table)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    count = partial(_count_rows, path=path, shared=shared, name=uuid.uuid4().hex, limit=limit, memory=memory)
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
