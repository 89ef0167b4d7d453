"""Compression-distance classification of text windows with zstandard dictionaries.

A window is a word of the lower-cased text, spaces around it. Two dictionaries are trained by zstandard and stand apart:
one on ordinary texts, and one on toxic texts. The latter's samples are toxic texts without the windows that ordinary
texts have as well: the trainer takes what comes back in most samples, and the language both kinds share would fill it.
A window's gain is by how many bytes the toxic dictionary codes it shorter than the ordinary one. A document's score is a
calibrated function of how many of its windows reach each gain.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain
from math import ceil

import numpy as np
import zstandard

from contactloom.llm.pretokens import Numbers

#: Lower-cased UTF-8: letters and digits; longer runs are several windows.
WORD = re.compile(rb"[0-9a-z\x80-\xff]{1,48}")
#: A piece of a training sample within one window.
PIECE = re.compile(rb"[ 0-9a-z\x80-\xff]{3,}")
#: A window counts from these gains on (bytes).
GAINS = (1, 2, 3, 4, 5, 6)
#: Stands behind every window, as the compressor looks for no match in the last bytes of its input and stores what hardly
#: shrinks: bytes that no UTF-8 text has in this order, and that both dictionaries end with.
TAIL = bytes(range(128, 160)) + bytes(range(1, 9))
#: Stands between the windows of a training sample, as long as the trainer's patterns.
APART = bytes(range(1, 9))


def windows_of(text: str) -> list[bytes]:
    """The words of the whole text, in order."""
    return WORD.findall(text.lower().encode())


def joined(windows: list[bytes]) -> bytes:
    return b" " + b" ".join(windows) + b" "


def trained(size: int, texts: Iterable[bytes], total: int = 0, most: int = 1 << 24) -> bytes:
    """A dictionary of at most `size` bytes, trained on texts in pieces of 256 bytes. Where the texts' `total` bytes are over
    `most`, pieces are chosen by their hash, so that about `most` bytes from all texts are. Under twice `size` there is too
    little to train on, and the last `size` bytes of the pieces are the dictionary."""
    step = max(1, ceil(total / most))
    pieces = (t[i : i + 256] for t in texts for i in range(0, len(t), 256))
    samples = [p for p in pieces if step == 1 or zlib.crc32(p) % step == 0]
    try:
        if len(samples) < 16 or sum(map(len, samples)) < 2 * size:
            raise zstandard.ZstdError("few samples")
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def contrasted(toxic: list[np.ndarray], ordinary: list[np.ndarray], words: list[bytes], size: int, least: int, share: float, seed: int = 1) -> bytes:
    """A dictionary of at most `size` bytes, trained on the toxic texts, one sample a text. A sample holds the text's
    windows, given by number, but for those that fewer than `least` toxic texts have, or `share` times as large a part of
    the ordinary texts. They stand in random order and apart, so that no pair of neighbours is taken for a pattern. Where
    there is too little to train on, the samples' own windows are the dictionary."""

    def texts_with(texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for t in texts:
            out[np.unique(t)] += 1
        return out

    count, others = texts_with(toxic), texts_with(ordinary)
    kept = (count >= least) & (others / max(1, len(ordinary)) < share * count / max(1, len(toxic)))
    rng = np.random.default_rng(seed)
    own = (rng.permutation(np.unique(t[kept[t]])).tolist() for t in toxic)
    samples = [APART + APART.join(b" " + words[i] + b" " for i in some) + APART for some in own if some]
    try:
        found = zstandard.train_dictionary(size, samples, k=24, d=8).as_bytes()
    except zstandard.ZstdError:
        found = b"".join(samples)[-size:]
    # what the trainer kept of windows, without its tables and what stood between; the spaces are the samples' own
    held = b"".join(samples)
    return b"\n".join(x for x in dict.fromkeys(PIECE.findall(found)) if x in held)


@dataclass
class Gains:
    """What windows gain. Compressors are made where they are used, as they can't be sent."""

    ordinary: bytes
    toxic: bytes
    made: tuple = field(default=(), repr=False, compare=False)

    def __getstate__(self) -> tuple[bytes, bytes]:
        return self.ordinary, self.toxic

    def __setstate__(self, state: tuple[bytes, bytes]) -> None:
        self.ordinary, self.toxic = state
        self.made = ()

    def compressors(self) -> tuple:
        if not self.made:
            flags = zstandard.ZstdCompressionParameters(window_log=18, chain_log=18, hash_log=18, search_log=8, min_match=6, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            self.made = tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=flags) for d in (self.ordinary, self.toxic))
        return self.made

    def of(self, windows: list[bytes]) -> np.ndarray:
        if len(windows) > 1 << 16:
            return np.concatenate([self.of(windows[i : i + (1 << 16)]) for i in range(0, len(windows), 1 << 16)])
        if not windows:
            return np.zeros(0, np.int64)
        raw = b"".join(b" " + w + b" " + TAIL for w in windows)
        lengths = np.fromiter(map(len, windows), np.uint64, len(windows)) + np.uint64(2 + len(TAIL))
        parts = zstandard.BufferWithSegments(raw, np.stack([np.cumsum(lengths) - lengths, lengths], axis=1).tobytes())
        size = [np.fromiter((len(x) for x in c.multi_compress_to_buffer(parts, threads=1)), np.int64, len(windows)) for c in self.compressors()]
        return size[0] - size[1]


def features(gains: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """For each of n documents: log counts of windows at each gain, and their shares; docs: the document of each window."""
    windows = np.bincount(docs, minlength=n).astype(float)
    hits = np.stack([np.bincount(docs[gains >= g], minlength=n) for g in GAINS], axis=1)
    return np.concatenate([np.log1p(hits), np.sqrt(hits / np.maximum(windows, 1)[:, None])], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the last a constant, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """Features of texts in batches. Gains of windows are kept, and forgotten when there are more than `most`."""

    def __init__(self, gains: Gains, most: int = 400_000):
        self.gains, self.most = gains, most
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known = Numbers(), np.zeros(0, np.int64)

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.numbers) > self.most:
            self.clear()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if len(self.numbers) > len(self.known):
            self.known = np.concatenate([self.known, self.gains.of(list(self.numbers)[len(self.known) :])])
        return features(self.known[at], np.repeat(np.arange(len(texts)), counts), len(texts))


@dataclass
class Model:
    gains: Gains
    weights: np.ndarray
    shift: float

    def scorer(self) -> Scorer:
        return Scorer(self.gains)

    def scores(self, texts: list[str], scorer: Scorer | None = None) -> np.ndarray:
        x = (scorer or self.scorer()).features([windows_of(t) for t in texts])
        z = x @ self.weights[:-1] + self.weights[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


FOLDS = 5


def fold_of(text: str) -> int:
    """The fold of a training text; equal texts share one."""
    return zlib.crc32(text.encode()) % FOLDS


def fit(toxic: list[str], ordinary: list[str], level: float = 0.7, ordinary_size: int = 112_640, toxic_size: int = 16_384, least: float = 0.015, share: float = 0.1) -> Model | None:
    """The calibrated model; None where a class has fewer than 8 texts. Weights come from texts that the dictionaries
    haven't seen, by folds. Then `level` is put where the F1 measure of those texts is best. The toxic dictionary is trained
    on windows that a part `least` of the toxic texts have, and at least 4 of them."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if min(len(toxic), len(ordinary)) < 8:
        return None
    numbers = Numbers()  # texts are kept as numbers of their windows, each window once

    def numbered(text: str) -> np.ndarray:
        found = windows_of(text)
        return np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))

    texts = [[(fold_of(t), numbered(t)) for t in side] for side in (toxic, ordinary)]
    words = list(numbers)
    lengths = np.fromiter(map(len, words), np.int64, len(words))

    def gains_of(fold: int | None) -> Gains:
        a, b = ([own for f, own in side if f != fold] for side in texts)
        total = sum(int(lengths[own].sum()) + len(own) + 1 for own in b)
        dictionary = trained(ordinary_size, (joined([words[i] for i in own.tolist()]) for own in b), total)
        return Gains(dictionary, contrasted(a, b, words, toxic_size, max(4, ceil(least * len(a))), share))

    xs, ys = [], []
    for fold in range(FOLDS):
        held = [(own, y) for y, side in ((1, texts[0]), (0, texts[1])) for f, own in side if f == fold]
        flat = np.concatenate([own for own, _ in held]) if held else np.zeros(0, np.int32)
        used, at = np.unique(flat, return_inverse=True)
        gained = gains_of(fold).of([words[i] for i in used.tolist()])[at]
        xs.append(features(gained, np.repeat(np.arange(len(held)), [len(own) for own, _ in held]), len(held)))
        ys.append(np.array([y for _, y in held], float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    weights = logistic(x, y)
    z = x @ weights[:-1] + weights[-1]
    order = np.argsort(-z, kind="stable")
    caught = np.cumsum(y[order])
    f1 = 2 * caught / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    cut = (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
    return Model(gains_of(None), weights, float(np.log(level / (1 - level)) - cut))
