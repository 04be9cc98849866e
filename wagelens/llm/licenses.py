"""License notices in whole texts: exact phrases, and short notices within a few edits.

The fuzzy search: a notice that may differ by k edits is split into k + 1 pieces, of which
an occurrence must hold one unchanged. One automaton finds all pieces of all notices; where
one stands, the regex library matches the whole notice with bounded errors and reports span
and edits. Texts are compared as words: A-Z lower-cased, single spaces between words.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and the labels they stand for.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices of the fuzzy search, their labels, and the edits (letters) that each may differ by.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("licensed under the gnu general public license version 3", "gpl-3", 4),
    ("licensed under the gnu general public license version 2", "gpl-2", 4),
    ("licensed under the gnu lesser general public license", "lgpl", 4),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 6),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under the mozilla public license", "mpl", 4),
    ("all rights reserved", "all-rights-reserved", 2),
)
# Every byte that is no letter of a-z, digit or part of a longer character parts words.
_PARTING = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> bytes:
    """A text's words between single spaces, with a space before and after."""
    parts = (text or "").encode("utf-8", "replace").translate(_PARTING).split()
    return b" " + b" ".join(parts) + b" " if parts else b" "


def phrase_places(words: bytes) -> list[tuple[int, str]]:
    """(first word's number, label) of every place where a phrase's words stand."""
    found = []
    for phrase, label in PHRASES:
        wanted = f" {phrase} ".encode()
        at = words.find(wanted)
        while at >= 0:
            found.append((words.count(b" ", 0, at), label))
            at = words.find(wanted, at + 1)
    return found


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the notice cut in ``edits + 1`` nearly equal parts."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    """The automaton of all pieces and each notice's pattern."""

    def __init__(self):
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, _, edits) in enumerate(NOTICES):
            for offset, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((number, offset))
        self._automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self._automaton.add_word(piece, (len(piece), owners))
        self._automaton.make_automaton()
        self._patterns = [
            regex.compile(rf"(?e)(?<=\s)(?:{regex.escape(n)}){{e<={k}}}(?=\s)") for n, _, k in NOTICES
        ]

    def spans(self, words: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of every match, in characters of ``words``.

        Candidates near each other are searched in one stretch. Matches of one notice do not
        overlap; of two notices' that do, the one with fewer edits stays.
        """
        stretches: dict[int, list[list[int]]] = {}
        for last, (size, owners) in self._automaton.iter(words):
            for number, offset in owners:
                notice, _, edits = NOTICES[number]
                start = last + 1 - size - offset - edits - 1
                end = start + len(notice) + 2 * edits + 2
                known = stretches.setdefault(number, [])
                if known and start <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], end)
                else:
                    known.append([start, end])
        found = []
        for number, ranges in stretches.items():
            for start, end in ranges:
                # Room for the spaces that bound a match.
                for match in self._patterns[number].finditer(words, max(0, start - 1), end + 1):
                    found.append((number, match.start(), match.end(), sum(match.fuzzy_counts)))
        kept: list[tuple[int, int, int, int]] = []
        for match in sorted(found, key=lambda f: (f[3], f[1], f[0])):
            rivals = (k for k in kept if k[3] < match[3] and k[1] < match[2] and match[1] < k[2])
            if next(rivals, None) is None:
                kept.append(match)
        return sorted(kept, key=lambda f: (f[1], f[0]))


@lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int]]]:
    """Number of words, exact phrase places, and fuzzy matches as
    (first word, number of words, label, edits)."""
    words = words_of(text)
    decoded = words.decode("utf-8", "replace")
    spaces: list[int] = []
    matches = []
    for number, start, end, edits in finder().spans(decoded):
        if not spaces:
            spaces = [i for i, c in enumerate(decoded) if c == " "]
        first = bisect.bisect_left(spaces, start) - 1
        last = bisect.bisect_left(spaces, end) - 1
        matches.append((first, last - first + 1, NOTICES[number][1], edits))
    return words.count(b" ") - 1, phrase_places(words), matches


_FOUND = "doc_id bigint, n_words bigint, places array<struct<word: bigint, label: string>>, " \
    "matches array<struct<word: bigint, n_words: bigint, label: string, edits: int>>"


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    match = pa.struct([
        ("word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("edits", pa.int32()),
    ])
    for batch in batches:
        scanned = [scan(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([n for n, _, _ in scanned], pa.int64()),
                pa.array([[dict(zip(("word", "label"), p)) for p in ps] for _, ps, _ in scanned], pa.list_(place)),
                pa.array(
                    [[dict(zip(("word", "n_words", "label", "edits"), m)) for m in ms] for _, _, ms in scanned],
                    pa.list_(match),
                ),
            ],
            names=["doc_id", "n_words", "places", "matches"],
        )


def notices(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, places, matches`` for every row: exact phrases and fuzzy notices,
    each with the number of its first word. A null text has no words."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan_rows, _FOUND)


def license_documents(docs: DataFrame) -> DataFrame:
    """Per document: words, exact places, their first and last start, labels and a score.

    ``base_labels`` are those of exact phrases, ``labels`` those and the fuzzy search's. The
    score is 1 with an exact phrase, else the best match's share of unchanged letters, else 0.
    """
    found = notices(docs)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sizes = F.create_map(*[F.lit(v) for n, label, _ in _longest() for v in (label, float(n))])
    likeness = F.transform(
        "matches", lambda m: F.greatest(F.lit(0.0), F.lit(1.0) - m["edits"] / F.element_at(sizes, m["label"]))
    )
    base = F.col("places.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("matches.label"))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(likeness), F.lit(0.0))).alias("score"),
    )


def _longest() -> list[tuple[int, str, int]]:
    """Letters of the longest notice of each label."""
    sizes: dict[str, int] = {}
    for notice, label, _ in NOTICES:
        sizes[label] = max(sizes.get(label, 0), len(notice))
    return [(n, label, 0) for label, n in sorted(sizes.items())]
