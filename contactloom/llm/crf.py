"""A linear-chain conditional random field that labels the words of code-switched text with languages.

A word's features are its character n-grams of one to four with marks at both ends (those with a mark are its affixes),
hashed, and the lexicons of frequent words that hold it. Labels of neighbours meet in a learned matrix of transitions.
Forward-backward gives each word's probability of each language.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex

from contactloom.llm.pretokens import LETTERS, Numbers, is_plain

BITS = 17
SIZES = (1, 2, 3, 4)
#: Words of a block. A longer text is several blocks, worked on side by side, between which the messages of
#: forward-backward are carried: a text is one chain.
BLOCK = 1024
FAST = re.compile(rf"[{LETTERS}]+")
FULL = regex.compile(r"\p{L}+")


def letter_words(text: str) -> list[str]:
    text = text.lower()
    return FAST.findall(text) if is_plain(text) else FULL.findall(text)


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words in a row, and the word of each."""
    chars = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    for n in SIZES:
        if len(chars) < n:
            continue
        inside = owner[: len(chars) - n + 1] == owner[n - 1 :]
        h = np.full(len(chars) - n + 1, np.uint64(0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF))
        for j in range(n):
            h = (h ^ chars[j : len(chars) - n + 1 + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        found.append((h[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[: len(chars) - n + 1][inside])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Field:
    """languages; lexicon: word -> indices of the languages it is frequent in; weights: a row a feature, the lexicons'
    last; transitions: from row to column; start."""

    languages: list[str]
    lexicon: dict[str, tuple[int, ...]]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, word, and scale of each word (the root of its number of features)."""
        f, o = gram_features(words)
        lex = [(i, 1 << BITS | k) for i, w in enumerate(words) for k in self.lexicon.get(w, ())]
        if lex:
            more = np.array(lex, np.int64)
            f, o = np.concatenate([f, more[:, 1]]), np.concatenate([o, more[:, 0]])
        return f, o, 1 / np.sqrt(np.bincount(o, minlength=len(words)))

    def emissions(self, words: list[str]) -> np.ndarray:
        f, o, scale = self.features(words)
        return np.stack([np.bincount(o, self.weights[f, k], len(words)) * scale for k in range(len(self.languages))], axis=1)


def forward_backward(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Chains e (chain, word, language), padded to one length: each word's probability of each language (0 beyond a
    chain's end), and with `pairs` the expected number of each transition (for chains without padding). A chain that is a
    part of a longer one has the weights (language) with which what stands before and after it `enter`s and `leave`s."""
    count, steps, k = e.shape
    # steps first, so that a step's numbers lie together
    x = np.exp(np.ascontiguousarray((e - e.max(axis=2, keepdims=True)).transpose(1, 0, 2)))
    trans, back = np.exp(transitions), np.ascontiguousarray(np.exp(transitions).T)
    enter = np.broadcast_to(np.exp(start), (count, k)) if enter is None else enter
    leave = np.ones((count, k)) if leave is None else leave
    alpha, beta = np.empty_like(x), np.empty_like(x)
    a = x[0] * enter
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ trans) * x[t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    shortest = int(lengths.min()) if count else 0
    beta[steps - 1] = leave
    for t in range(steps - 2, -1, -1):
        b = (x[t + 1] * beta[t + 1]) @ back
        b /= b.sum(axis=1, keepdims=True)
        if t + 1 >= shortest:
            ended = t + 1 >= lengths
            b[ended] = leave[ended]
        beta[t] = b
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    joint = None
    if pairs:
        both = alpha[:-1, :, :, None] * trans * (x[1:] * beta[1:])[:, :, None, :]
        joint = (both / both.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
    p[np.arange(steps)[:, None] >= lengths] = 0.0
    return p.transpose(1, 0, 2), joint


def crossings(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """For each chain the matrix (from the weights that enter its first word, to those of its last), up to a factor."""
    count, steps, k = e.shape
    x = np.exp(np.ascontiguousarray((e - e.max(axis=2, keepdims=True)).transpose(1, 0, 2)))
    trans = np.exp(transitions)
    out = np.zeros((count, k, k))
    out[:, np.arange(k), np.arange(k)] = x[0]
    for t in range(1, steps):
        more = t < lengths
        m = (out @ trans) * x[t][:, None, :]
        m /= m.max(axis=(1, 2), keepdims=True)
        out = np.where(more[:, None, None], m, out)
    return out


def ends(through: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters and leaves each block of chains, from the blocks' crossings in order; `first` marks a chain's first
    block."""
    n, k = len(through), len(start)
    trans = np.exp(transitions)
    enter, leave = np.empty((n, k)), np.ones((n, k))
    for b in range(n):
        v = np.exp(start) if first[b] else (enter[b - 1] @ through[b - 1]) @ trans
        enter[b] = v / v.sum()
    for b in range(n - 2, -1, -1):
        if not first[b + 1]:
            v = trans @ (through[b + 1] @ leave[b + 1])
            leave[b] = v / v.sum()
    return enter, leave


def fit(texts: list[tuple[str, str]], seed: int = 5, span: int = 32, per_text: int = 4, chains: int = 1500, spans: int = 3, stay: float = 0.8, lexicon: int = 300, rounds: int = 40, ridge: float = 1e-4) -> Field | None:
    """A field from (text, language) pairs. Chains are put together from spans of texts, the next span in the same
    language with probability `stay`, so that transitions are seen. None without texts that have letters."""
    rng = np.random.default_rng(seed)
    pool: dict[str, list[list[str]]] = {}
    seen: dict[str, Counter] = {}
    for text, language in texts:
        words = letter_words(text)
        seen.setdefault(language, Counter()).update(set(words))
        cut = [words[i : i + span] for i in range(0, len(words), span)]
        cut = [w for w in cut if len(w) == span] or [(words * span)[:span]] * bool(words)
        for i in rng.permutation(len(cut))[:per_text]:
            pool.setdefault(language, []).append(cut[i])
    languages = sorted(pool)
    if not languages:
        return None
    k = len(languages)
    members: dict[str, tuple[int, ...]] = {}
    for i, language in enumerate(languages):
        for w, _ in sorted(seen[language].items(), key=lambda x: (-x[1], x[0]))[:lexicon]:
            members[w] = (*members.get(w, ()), i)
    field = Field(languages, members, np.zeros(((1 << BITS) + k, k)), np.zeros((k, k)), np.zeros(k))

    numbers = Numbers()
    at, y = np.zeros((chains, span * spans), np.int64), np.zeros((chains, span * spans), np.int64)
    for c in range(chains):
        i = int(rng.integers(k))
        for s in range(spans):
            if s and rng.random() > stay:
                i = int(rng.integers(k))
            own = pool[languages[i]]
            at[c, s * span : (s + 1) * span] = [numbers[w] for w in own[int(rng.integers(len(own)))]]
            y[c, s * span : (s + 1) * span] = i
    words = list(numbers)
    f, o, scale = field.features(words)
    truth = np.eye(k)[y]
    seen_pairs = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
    begins = np.bincount(y[:, 0], minlength=k)
    total = at.size
    params = [field.weights, field.transitions, field.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        e = np.stack([np.bincount(o, field.weights[f, j], len(words)) * scale for j in range(k)], axis=1)[at]
        p, pairs = forward_backward(e, np.full(chains, span * spans), field.transitions, field.start, pairs=True)
        miss = (truth - p).reshape(-1, k)
        by_word = np.stack([np.bincount(at.ravel(), miss[:, j], len(words)) for j in range(k)], axis=1) * scale[:, None]
        grads = [np.stack([np.bincount(f, by_word[o, j], len(field.weights)) for j in range(k)], axis=1), seen_pairs - pairs, begins - p[:, 0].sum(axis=0)]
        for i, (q, g) in enumerate(zip(params, grads, strict=True)):
            g = g / total - ridge / 10 * q
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            q += 0.15 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    field.weights = field.weights.astype(np.float32)
    return field


class Labeller:
    """Labels texts in batches; emissions of words are kept, and forgotten when there are more than `most`."""

    def __init__(self, field: Field, most: int = 400_000):
        self.field, self.most = field, most
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known = Numbers(), np.zeros((0, len(self.field.languages)))
        self.used = 0

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the mean probability of each language over its words, and how many words it has."""
        k = len(self.field.languages)
        if len(self.numbers) > self.most:
            self.clear()
        lists = [letter_words(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter((n for t in lists for n in map(self.numbers.__getitem__, t)), np.int64, int(counts.sum()))
        if len(self.numbers) > self.used:
            new = list(self.numbers)[self.used :]
            if len(self.numbers) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((max(len(self.numbers), 2 * len(self.known)) - len(self.known), k))])
            for i in range(0, len(new), 1 << 15):
                part = new[i : i + (1 << 15)]
                self.known[self.used : self.used + len(part)] = self.field.emissions(part)
                self.used += len(part)
        sums = np.zeros((len(texts), k))
        begins = np.cumsum(counts) - counts
        blocks = [(min(BLOCK, n - i), b + i, d, i == 0, n > BLOCK) for d, (b, n) in enumerate(zip(begins.tolist(), counts.tolist(), strict=True)) for i in range(0, n, BLOCK)]
        if not blocks:
            return sums, counts
        lengths, starts, docs, first, long = (np.array(v) for v in zip(*blocks, strict=True))
        enter, leave = np.tile(np.exp(self.field.start), (len(blocks), 1)), np.ones((len(blocks), k))
        emission = lambda own: self.known[at[np.minimum(starts[own][:, None] + np.arange(lengths[own].max()), len(at) - 1)]]
        parts = np.flatnonzero(long)
        if len(parts):
            through = np.concatenate([crossings(emission(own), lengths[own], self.field.transitions) for own in np.array_split(parts, -(-len(parts) // 512))])
            enter[parts], leave[parts] = ends(through, first[parts], self.field.transitions, self.field.start)
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1  # blocks of about one length, so that little is padding
            while j < len(order) and j - i < 512 and lengths[order[j]] <= lengths[order[i]] * 1.2 + 8:
                j += 1
            own = order[i:j]
            p, _ = forward_backward(emission(own), lengths[own], self.field.transitions, self.field.start, enter=enter[own], leave=leave[own])
            np.add.at(sums, docs[own], p.sum(axis=1))
            i = j
        return sums / np.maximum(counts, 1)[:, None], counts
