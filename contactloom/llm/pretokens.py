"""Pre-tokens by public_tokenizers.PATTERN, and dictionaries of them that grow in bulk."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Texts of these characters alone give the same matches by the standard module, at twice the speed.
OTHER = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}¡§«°»¿–—‘-„…€]")
FAST = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
FULL = regex.compile(public_tokenizers.PATTERN)


def is_plain(text: str) -> bool:
    return OTHER.search(text) is None


def pretokens(text: str) -> list[str]:
    """The matches; a text is their concatenation."""
    return FAST.findall(text) if is_plain(text) else FULL.findall(text)


def is_even(texts: pa.Array) -> pa.Array:
    """Which texts are plain and have no white space behind a space: no match crosses a cut before one of their spaces."""
    return pc.invert(pc.or_(pc.match_substring_regex(texts, OTHER.pattern), pc.match_substring_regex(texts, r" [ \t\n\r]")))


#: Marks the piece at a text's start, which has no space before it; no plain text has it.
FIRST = "\0"


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Even texts cut before their spaces, the spaces left out and first pieces marked: all pieces in a row, and how many
    each text has."""
    found = pc.split_pattern(pc.binary_join_element_wise(FIRST, texts, ""), " ")
    return found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)


def piece_tokens(found: pa.Array) -> list[list[str]]:
    """The matches of each piece."""
    alone = pc.utf8_is_alpha(found).to_numpy(zero_copy_only=False).tolist()
    given = found.to_numpy(zero_copy_only=False).tolist()
    return [[" " + p] if a else FAST.findall(p[1:] if p[:1] == FIRST else " " + p) for p, a in zip(given, alone, strict=True)]


class Numbers(dict):
    """Words numbered from 0 as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of runs of values, `counts` of them a run."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


class WordIds:
    """Ids of words, each word encoded once. Forgets all when it holds more than `most` words, so that a worker that
    serves many tasks stays small; a forgotten word is encoded anew."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], dtype: type, most: int = 700_000):
        self.encode, self.dtype, self.most = encode, dtype, most
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.flat = np.zeros(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    @staticmethod
    def grown(a: np.ndarray, least: int) -> np.ndarray:
        return a if len(a) >= least else np.concatenate([a, np.zeros(max(least, 2 * len(a)) - len(a), a.dtype)])

    def learn(self, words: list[str]) -> None:
        ids = self.encode(words)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total, count = int(n.sum()), self.known + len(ids)
        self.flat = self.grown(self.flat, self.used + total)
        self.starts, self.lengths = self.grown(self.starts, count), self.grown(self.lengths, count)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), self.dtype, total)
        self.starts[self.known : count] = self.used + np.cumsum(n) - n
        self.lengths[self.known : count] = n
        self.used, self.known = self.used + total, count

    def ids(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists of words in a row, and how many each list has."""
        if len(self.numbers) > self.most:
            self.clear()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if len(self.numbers) > self.known:
            self.learn(list(islice(self.numbers, self.known, None)))
        n = self.lengths[at]
        return self.flat[ranges(self.starts[at], n)], sums(n, counts)
