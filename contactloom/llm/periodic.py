"""Stretches of words that repeat with a period, found by recompression.

Texts of a batch become one sequence of numbers, parted by marks that occur once. Candidates stand on the harmonic grid:
a run of period p and three periods or more covers two neighbouring multiples of p, at which the words p further on are
the same. `recompressed` takes texts with candidates to ever shorter sequences, by turns naming blocks of one symbol and
pairs of a left and a right symbol, so that equal names are equal stretches; a block is kept as the place where it ends.
`common` extends pairs of places over these levels: up where both start a name and the names agree, on by whole blocks,
down where they differ. Its answers are exact, forwards and, on the mirrored levels, backwards. All of it is numpy on a
batch, whose texts are taken by bytes; a text of any length is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import fresh, on_workers

#: Least words of a run, and least periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of text that are worked on at once, or one text.
CALL_BYTES = 1 << 21
#: Pairs of places that are extended at once.
AT_ONCE = 1 << 19
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def recompressed(seq: np.ndarray, rng: np.random.Generator, least: int = 64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(levels, firsts): level 0 is the sequence; firsts[h][x] is where symbol x of level h + 1 begins in level h, with the
    length of level h at the end. A level's blocks of one symbol are named by symbol and length; names fall into two
    sides, of four draws the one that makes most pairs, and a left one with a right one after it is named as one."""
    levels, firsts, names = [seq], [], int(seq.max(initial=0)) + 1
    while len(levels[-1]) > least:
        t = levels[-1]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(starts, append=len(t))
        symbols = t[starts].copy()
        many = size > 1
        if many.any():
            found, which = np.unique(symbols[many] * (len(t) + 1) + size[many], return_inverse=True)
            symbols[many] = names + which
            names += len(found)
        best = np.zeros(0, np.int64)
        for odd in rng.integers(1 << 62, size=4, dtype=np.uint64) | np.uint64(1):
            right = (symbols.astype(np.uint64) * odd) >> np.uint64(63) == 1
            for side in (right, ~right):
                pairs = np.flatnonzero(~side[:-1] & side[1:])
                best = pairs if len(pairs) > len(best) else best
        if len(best):
            found, which = np.unique(symbols[best] * names + symbols[best + 1], return_inverse=True)
            symbols[best] = names + which
            names += len(found)
        elif len(symbols) == len(t):
            break
        kept = np.ones(len(symbols), bool)
        kept[best + 1] = False
        levels.append(symbols[kept])
        firsts.append(np.append(starts[kept], len(t)))
    return levels, firsts


def laid_out(levels: list[np.ndarray], firsts: list[np.ndarray], mirrored: bool) -> tuple[np.ndarray, ...]:
    """(symbol, block end, first child, parent) of all levels one after the other, level 0 first, each an index into the
    same arrays; -1 for no child and for a place that begins no symbol of the next level. Mirrored: read from the right."""
    at = np.cumsum([0, *(len(t) for t in levels)])
    symbol, end = np.concatenate([t[::-1] if mirrored else t for t in levels]), np.empty(at[-1], np.int64)
    child, parent = np.full(at[-1], -1), np.full(at[-1], -1)
    for h, t in enumerate(levels):
        t = t[::-1] if mirrored else t
        ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t))
        end[at[h] : at[h + 1]] = at[h] + np.repeat(ends, np.diff(ends, prepend=0))
        if h:
            own = np.arange(at[h], at[h + 1])
            below = firsts[h - 1]
            child[own] = at[h - 1] + ((below[-1] - below[1:])[::-1] if mirrored else below[:-1])
            parent[child[own]] = own
    return symbol, end, child, parent


def common(sides: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols of level 0 agree from places i and j on; the sequence ends with a symbol that occurs once."""
    symbol, end, child, parent = sides
    a, b = i.copy(), j.copy()
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_], b[open_]
        same = symbol[x] == symbol[y]
        up, over = parent[x], parent[y]
        rise = same & (up >= 0) & (over >= 0)
        rise[rise] = symbol[up[rise]] == symbol[over[rise]]
        step = np.minimum(end[x] - x, end[y] - y)
        down, under = child[x], child[y]
        ended = ~same & (down < 0)
        a[open_] = np.where(rise, up, np.where(same, x + step, np.where(ended, x, down)))
        b[open_] = np.where(rise, over, np.where(same, y + step, np.where(ended, y, under)))
        open_ = open_[~ended]
    return a - i


def grid_candidates(seq: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): grid places from which as many neighbours as any run has agree with the words a period on. Texts
    stand by falling size, so those with room for a period are a prefix of the sequence."""
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    longest = int(sizes.max(initial=0)) // LEAST_PERIODS
    room = np.maximum(LEAST_WORDS, LEAST_PERIODS * np.arange(longest + 1))
    fitting = np.searchsorted(-sizes, -room, side="right")
    for p in range(1, longest + 1):
        if not fitting[p]:
            continue
        row = seq[: starts[fitting[p] - 1] + sizes[fitting[p] - 1] : p]
        same = row[1:] == row[:-1]
        need = (int(room[p]) - p) // p  # neighbours on the grid within the agreeing part of a run
        hits = np.flatnonzero(same)
        if len(hits) >= need:
            hits = hits[: len(hits) - need + 1][hits[need - 1 :] - hits[: len(hits) - need + 1] == need - 1]
            places.append(hits * p)
            periods.append(np.full(len(hits), p))
    return np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[np.ndarray], seed: int = 0) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs by start, then period; texts are arrays of numbers from 0 on."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((k for k, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda k: -len(texts[k]))
    for again in (False, True):  # the second time of texts with candidates only
        if not order:
            return out
        sizes = np.array([len(texts[k]) for k in order])
        marks = int(max(texts[k].max() for k in order)) + 1 + np.arange(len(order) + 1)
        seq = np.concatenate([marks[:1], *(x for n, k in enumerate(order) for x in (texts[k], marks[n + 1 : n + 2]))])
        starts = np.cumsum([1, *(sizes[:-1] + 1)])
        at, p = grid_candidates(seq, starts, sizes)
        if not again:
            order = [order[k] for k in np.unique(np.searchsorted(starts, at, side="right") - 1) if k >= 0]
    levels, firsts = recompressed(seq, np.random.default_rng(seed))
    ahead, behind = laid_out(levels, firsts, False), laid_out(levels, firsts, True)
    found = []
    for k in range(0, len(at), AT_ONCE):
        i, period = at[k : k + AT_ONCE], p[k : k + AT_ONCE]
        after = common(ahead, i, i + period)
        before = common(behind, len(seq) - i, len(seq) - i - period)
        lo, size = i - before, before + after + period
        good = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.unique(np.stack([lo, lo + size, period])[:, good], axis=1))
    rows = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    first = np.ones(rows.shape[1], bool)  # a run of a multiple of its period is the same stretch
    first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    rows = rows[:, first]
    owner = np.searchsorted(starts, rows[0], side="right") - 1
    for k, lo, hi, period in zip(owner.tolist(), (rows[0] - starts[owner]).tolist(), (rows[1] - starts[owner]).tolist(), rows[2].tolist(), strict=True):
        out[order[k]].append((lo, hi - lo, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.cumsum(edges[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def found_in(texts: list[bytes | None]) -> list[dict]:
    out: list[dict] = []
    at = 0
    while at < len(texts):
        rows, held = [], 0
        while at + len(rows) < len(texts) and (not rows or held < CALL_BYTES):
            rows.append((texts[at + len(rows)] or b"").split())  # at the six ASCII white-space characters
            held += len(texts[at + len(rows) - 1] or b"")
        ids: dict[bytes, int] = {}
        numbers = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in rows]
        for words, runs in zip(rows, runs_of(numbers), strict=True):
            spans = [{"start": s, "length": n, "period": q} for s, n, q in runs]
            out.append({"runs": spans, "collapsed": collapsed_words(words, runs).decode()})
        at += len(rows)
    return out


def periodic(text: Column) -> Column:
    """struct(runs, collapsed) of each text."""

    @F.arrow_udf(f"struct<runs: {RUNS}, collapsed: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        kind = pa.struct([("runs", pa.list_(span)), ("collapsed", pa.string())])
        for batch in batches:
            yield pa.array(found_in(batch.cast(pa.binary()).to_pylist()), kind)

    return run(text)


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The rows with `runs`, an array of (start, length, period) in words `[^\\x20\\x09-\\x0D]+` numbered from 0, and
    `collapsed`, the text's words joined by one space, without those that a run holds after its first period. A run is a
    stretch with smallest period q of at least 24 words and three periods that can't be extended keeping q. Null and empty
    texts have no runs and an empty `collapsed`; repeated rows and nulls in other columns stay as they are; an empty table
    gives an empty table. Columns of these two names are replaced. No row moves."""
    on_workers(df.sparkSession)
    (both,) = fresh(df, "found")
    return df.withColumn(both, periodic(F.col(text))).withColumns({runs: F.col(both)["runs"], collapsed: F.col(both)["collapsed"]}).drop(both)
