"""Two zstandard dictionaries, toxic and ordinary, and how much better one of them compresses.

Plain Python helpers: fitted once on a bounded sample, then used inside tasks on whole texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard as zstd

WINDOW, STRIDE = 80, 60
BASE_BYTES = 16_000
_WORD = re.compile(r"[^\W\d_]+")
# The same match finder for both dictionaries, whatever their sizes, and bare frames: only
# then do two lengths of one window differ by the dictionaries alone.
_PARAMETERS = {
    "window_log": 18, "chain_log": 15, "hash_log": 15, "search_log": 5, "min_match": 5,
    "target_length": 32, "strategy": zstd.STRATEGY_LAZY2,
}


@dataclass(frozen=True)
class Model:
    """What a task needs: both dictionaries' contents and the calibrated weights."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _encoded(text: str | None) -> bytes:
    return (" " + " ".join((text or "").lower().split()) + " ").encode("utf-8", "replace")


def _segments(size: int) -> np.ndarray:
    """Offsets and lengths of overlapping windows that cover all of ``size`` bytes."""
    starts = np.arange(0, max(1, size - (WINDOW - STRIDE)), STRIDE, dtype="<u8")
    return np.stack([starts, np.minimum(WINDOW, size - starts)], axis=1).astype("<u8")


class Scorer:
    """The two compressors of a model."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self._toxic, self._ordinary = (_compressor(d) for d in (model.toxic, model.ordinary))

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves against the ordinary one, for each window."""
        data = _encoded(text)
        windows = zstd.BufferWithSegments(data, _segments(len(data)).tobytes())
        toxic, ordinary = (
            np.fromiter((len(x) for x in c.multi_compress_to_buffer(windows)), np.int32)
            for c in (self._toxic, self._ordinary)
        )
        return ordinary - toxic

    def score(self, text: str | None) -> float:
        z = float(features(self.gains(text)) @ self.weights)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters(
        **_PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def features(gains: np.ndarray) -> np.ndarray:
    """A document's windows in a few numbers; none grows with mere length but the last."""
    top = np.sort(gains)[::-1][:4].astype(float)
    top = np.concatenate([top, np.zeros(4 - len(top))])
    n = len(gains)
    return np.array([
        1.0, top[0], top[1], top[2], top[3],
        np.log1p((gains >= 4).sum()), np.log1p((gains >= 6).sum()),
        (gains >= 4).sum() / (n + 10.0) * 10, np.log1p(n),
    ])


def _contexts(texts: Sequence[str]) -> Counter:
    """Each word's number of different neighbourhoods: copies of a text count once."""
    seen = defaultdict(set)
    for text in texts:
        words = _WORD.findall(text.lower())
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            seen[word].add((before, after))
    return Counter({word: len(around) for word, around in seen.items()})


def train(toxic: Sequence[str], ordinary: Sequence[str]) -> tuple[bytes, bytes]:
    """The two dictionaries' contents.

    The ordinary one holds the commonest ordinary words. The toxic one holds the same, so
    that ordinary text compresses alike, and before them the words that toxic texts use in
    many places and ordinary ones nearly never; the ordinary one has noise of that size.
    """
    theirs, ours = _contexts(toxic), _contexts(ordinary)
    share = max(len(ordinary), 1) / max(len(toxic), 1)
    least = max(3, 0.02 * len(toxic))
    own = [w for w, n in theirs.most_common() if n >= least and ours[w] < 0.02 * n * share]
    common = Counter(word for text in ordinary for word in text.lower().split())
    base = " ".join(["", *(w for w, _ in reversed(common.most_common(20_000))), ""])
    base = base.encode("utf-8", "replace")[-BASE_BYTES:].rjust(8)
    lead = " ".join(["", *reversed(own[:2_000]), ""]).encode("utf-8", "replace")
    noise = np.random.default_rng(1).integers(128, 256, len(lead), dtype=np.uint8).tobytes()
    return lead + base, noise + base


def calibrate(rows: np.ndarray, labels: np.ndarray, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighted alike by half."""
    weights = np.zeros(rows.shape[1])
    positive = max(labels.mean(), 1e-3)
    importance = np.where(labels > 0, (1 - positive) ** 0.5 / positive**0.5, 1.0)
    penalty = np.eye(rows.shape[1]) * 0.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (importance * (labels - p)) - penalty @ weights
        hessian = (rows * (importance * p * (1 - p))[:, None]).T @ rows + penalty
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(sample: Sequence[tuple[str, int]]) -> Model:
    """Dictionaries from two thirds of the sample, weights from the other: texts that are in a
    dictionary compress too well to calibrate on. Without both labels every text scores low."""
    toxic = list(dict.fromkeys(t for t, y in sample if y == 1))
    ordinary = list(dict.fromkeys(t for t, y in sample if y == 0))
    if len(toxic) < 4 or len(ordinary) < 4:
        return Model(b" " * 16, b" " * 16, (-4.0, *[0.0] * 8))
    contents = train(*([t for i, t in enumerate(texts) if i % 3] for texts in (toxic, ordinary)))
    scorer = Scorer(Model(*contents, (0.0,) * 9))
    held = [(t, 1) for t in toxic[::3]] + [(t, 0) for t in ordinary[::3]]
    rows = np.array([features(scorer.gains(t)) for t, _ in held])
    weights = calibrate(rows, np.array([y for _, y in held], dtype=float))
    # The weights stay; the dictionaries are made anew from all of the sample.
    return Model(*train(toxic, ordinary), tuple(float(w) for w in weights))
