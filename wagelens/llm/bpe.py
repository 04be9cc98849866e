"""Byte-pair encoding of whole texts, and back.

Two encoders with one interface. ``LibraryEncoder`` gives a text's words to the tokenizers
library. ``BoundaryEncoder`` splits at forced boundaries: two neighbouring bytes that stand
side by side inside no token of the vocabulary can never be merged, so a word is cut there
for certain, and its fragments are encoded apart and joined.

Both work by white space: the tokenizer's own split never crosses it, so a text's ids are
those of its words in order. A word's ids are remembered, up to ``MEMORY`` words a worker, for as long as a task runs.
The vocabulary file is a parameter and is read where the work is done.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMORY = 250_000
_BATCH = 50_000
_WORDS_AT_ONCE = 200_000
# White space as the tokenizer sees it. str.split() also splits at the four separators
# U+001C to U+001F, so texts that hold one are split by this pattern.
_SPACE = re.compile("[\t\n\v\f\r \x85\xa0  -     　]+")
_SEPARATOR = re.compile("[\x1c-\x1f]")
_CORE = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([^A-Za-z0-9\x00-\x1f\x7f-\U0010ffff'<]*)")


def _alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is
    visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


_ALPHABET = _alphabet()


def words_of(text: str) -> list[str]:
    if _SEPARATOR.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


class Vocabulary:
    """The parts of a tokenizer file that the encoders use."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        names = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [names.get(i, "").encode("utf-8") for i in range(max(names) + 1)]

    def bare_tokenizer(self, final: bool = True, spelled: bool = False):
        """The merges alone, for words in normal form between spaces.

        A final fragment ends a word and carries the word-end mark; others do not. With
        ``spelled`` the words are written in the vocabulary's alphabet already.
        """
        from tokenizers import Tokenizer, models, pre_tokenizers

        ending = {"end_of_word_suffix": self.suffix} if final and self.suffix else {}
        bare = Tokenizer(models.BPE(vocab=self.ids, merges=self.merges, **ending))
        steps = [pre_tokenizers.WhitespaceSplit()]
        if not spelled:
            steps.append(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        bare.pre_tokenizer = pre_tokenizers.Sequence(steps)
        return bare


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def encoder(kind: type, path: str):
    """One encoder a worker process: what it remembers serves all of the worker's tasks."""
    return kind(vocabulary(path))


@contextmanager
def task_encoder(kind: type, path: str) -> Iterator:
    """The worker's encoder for one task. What it remembered is let go when the task ends, so
    that a worker waiting for other stages' tasks holds no words, and the memory of the task's
    batches goes back to the system."""
    found = encoder(kind, path)
    try:
        yield found
    finally:
        found.forget()
        _give_back()


def _give_back() -> None:
    """Freed memory back to the system, where the C library can (glibc)."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


class Memory:
    """What a worker remembers, in two generations: used lately, and used before that. When the
    first is half of ``size`` it becomes the second, so what is used often is never learned again."""

    def __init__(self):
        self.recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def provide(self, keys: Iterable[str], size: int, learn: Callable[[list[str]], Iterable[bytes]]) -> dict[str, bytes]:
        """A dictionary that holds all of ``keys``, which may repeat."""
        if len(self.recent) > size // 2:
            self._older, self.recent = self.recent, {}
        recent, older = self.recent, self._older
        absent = set(keys).difference(recent)
        recent.update((k, older[k]) for k in absent if k in older)
        new = [k for k in absent if k not in older]
        recent.update(zip(new, learn(new)))
        return recent


class _Remembering:
    memory = MEMORY

    def __init__(self, known: Vocabulary):
        self.known = known
        self._memory = Memory()

    def forget(self) -> None:
        """Let go of all remembered words; what is asked later is learned again."""
        self._memory = Memory()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit integers; a null text has none."""
        group, size = [], 0
        for text in texts:
            group.append(words_of(text) if text else [])
            size += len(group[-1])
            if size >= _WORDS_AT_ONCE:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        known = self._memory.provide(chain.from_iterable(group), self.memory, self._learn)
        for words in group:
            yield b"".join(map(known.__getitem__, words))

    def _learn(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), _BATCH):
            yield from self._ids_of(words[start : start + _BATCH])

    def _ids_of(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _library_ids(self, words: list[str]) -> list[bytes]:
        encoded = self.known.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]


def _ids(tokenizer, text: str) -> np.ndarray:
    """The ids of a text; the library's batch form keeps no places, which nothing here reads."""
    (encoded,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
    return np.array(encoded.ids, dtype="<u4")


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, out, start = ids.astype("<u4").tobytes(), [], 0
    for end in (ends * 4).tolist():
        out.append(raw[start:end])
        start = end
    return out


class LibraryEncoder(_Remembering):
    """Words through the tokenizers library.

    Plain words, Latin letters with punctuation after them, need no normal form but lower case
    and no further split: they go to the library's merges many at a time and are told apart by
    their word-end marks, and are remembered for other cases and punctuation. All others go
    through the whole tokenizer.
    """

    memory = 400_000

    def __init__(self, known: Vocabulary):
        super().__init__(known)
        self._ends = np.array([n.endswith(known.suffix.encode()) for n in known.names])
        self._bare = known.bare_tokenizer()
        self._pieces = Memory()

    def forget(self) -> None:
        super().forget()
        self._pieces = Memory()

    def _ids_of(self, words: list[str]) -> list[bytes]:
        plain = {w: m.groups() for w in words if (m := _CORE.fullmatch(w.lower()))}
        known = self._pieces.provide(chain.from_iterable(plain.values()), self.memory, self._plain_ids)
        others = [w for w in words if w not in plain]
        rest = dict(zip(others, self._library_ids(others)))
        return [known[plain[w][0]] + known[plain[w][1]] if w in plain else rest[w] for w in words]


    def _plain_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of words in normal form; the empty one has none."""
        words = [p for p in pieces if p]
        ids = _ids(self._bare, " ".join(words))
        ends = np.flatnonzero(self._ends[ids]) + 1 if len(ids) else np.empty(0, int)
        if len(ends) != len(words):
            raise RuntimeError("a plain word was not one word to the tokenizer")
        found = dict(zip(words, _cut(ids, ends)))
        return [found.get(p, b"") for p in pieces]


class BoundaryEncoder(_Remembering):
    """Words cut at forced boundaries, fragments encoded independently and concatenated.

    Normal form and split into words are the library's, but for plain Latin letters with
    punctuation after them, whose normal form is lower case; a word that holds the string of a
    special token is left to it altogether.
    """

    def __init__(self, known: Vocabulary):
        super().__init__(known)
        self.joined = inner_pairs(known.ids, known.suffix)
        self._tokenizers = {final: known.bare_tokenizer(final, spelled=True) for final in (False, True)}
        self._fragments: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        # A mark between fragments that are encoded in one call; never a fragment itself.
        self._mark = {final: self._tokenizers[final].encode("Ā").ids for final in (False, True)}

    def forget(self) -> None:
        super().forget()
        self._fragments = {False: {}, True: {}}

    def fragments(self, word: str) -> list[str]:
        """The pieces of a word, written in the vocabulary's alphabet, between forced cuts."""
        joined = self.joined
        cuts = [i for i, pair in enumerate(zip(word, word[1:-1]), 1) if pair not in joined]
        if len(word) > 1 and (word[-2], word[-1] + self.known.suffix) not in joined:
            cuts.append(len(word) - 1)
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        own, rest = {}, []
        for word in words:
            if plain := _CORE.fullmatch(word):
                own[word] = [self._spelled(p) for p in plain.groups() if p]
            elif not any(s in word for s in self.known.special):
                rest.append(word)
        own |= self._split(rest)
        parts = {w: [self.fragments(p) for p in pieces] for w, pieces in own.items()}
        inner, ends = self._fragments[False], self._fragments[True]
        for final, known in self._fragments.items():
            if len(known) > MEMORY // 2:
                known.clear()
            used = (f for pieces in parts.values() for fs in pieces for f in (fs[-1:] if final else fs[:-1]))
            self._learn_fragments(final, [f for f in dict.fromkeys(used) if f not in known])
        ids = {
            w: b"".join(b"".join([*map(inner.__getitem__, fs[:-1]), ends[fs[-1]]]) for fs in pieces)
            for w, pieces in parts.items()
        }
        others = [w for w in words if w not in ids]
        ids.update(zip(others, self._library_ids(others)))
        return [ids[w] for w in words]

    @staticmethod
    def _spelled(piece: str) -> str:
        lower = piece.lower()
        return lower if lower.isascii() else "".join(map(_ALPHABET.__getitem__, lower.encode()))

    def _split(self, words: list[str]) -> dict[str, list[str]]:
        """Each word's pieces in normal form and the vocabulary's alphabet."""
        tokenizer, out = self.known.tokenizer, {}
        if not words:
            return out
        normal = tokenizer.normalizer.normalize_str(" ".join(words))
        places = np.cumsum([0, *(len(n) + 1 for n in normal.split(" "))])
        if len(places) != len(words) + 1:
            raise RuntimeError("normal form moved a word's end")
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        owners = np.searchsorted(places, [at for _, (at, _) in pieces], side="right") - 1
        for word in words:
            out[word] = []
        for (piece, _), owner in zip(pieces, owners.tolist()):
            out[words[owner]].append(piece)
        return out

    def _learn_fragments(self, final: bool, fragments: list[str]) -> None:
        tokenizer = self._tokenizers[final]
        for start in range(0, len(fragments), _BATCH):
            part = [f for f in fragments[start : start + _BATCH] if f != "Ā"]
            if not part:
                continue
            ids = _ids(tokenizer, " Ā ".join(part))
            marks = np.flatnonzero(ids == self._mark[final][0])
            edges = np.concatenate([[-1], marks, [len(ids)]])
            if len(marks) != len(part) - 1:
                raise RuntimeError("a fragment holds the mark")
            for f, a, b in zip(part, edges, edges[1:]):
                self._fragments[final][f] = ids[a + 1 : b].tobytes()
        if "Ā" in fragments:
            self._fragments[final]["Ā"] = np.array(self._mark[final], dtype="<u4").tobytes()


def inner_pairs(ids: Iterable[str], suffix: str) -> set[tuple[str, str]]:
    """The pairs of neighbouring symbols inside any token; a word's last symbol has the suffix."""
    pairs = set()
    for token in ids:
        symbols = list(token.removesuffix(suffix)) if suffix else list(token)
        if suffix and token.endswith(suffix) and symbols:
            symbols[-1] += suffix
        pairs.update(zip(symbols, symbols[1:]))
    return pairs


def decode(known: Vocabulary, ids: bytes) -> bytes:
    """The text of ids as UTF-8, special tokens included: token strings between spaces."""
    return b" ".join(map(known.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))
