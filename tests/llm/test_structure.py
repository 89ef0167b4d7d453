"""Conversation repair, line deduplication and periodic runs against plain versions, and on odd tables."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactloom.llm import conversations, line_dedup, periodic, queries, sharding

SF = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# conversations


def plain_edits(faults, initials):
    """(cost, letters) from the last row to the first, by state."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    kept = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}
    best = {"": (0, ""), "a": (0, ""), "s": (10**9, "~"), "u": (10**9, "~")}
    for i in range(len(faults), -1, -1):
        if i < len(faults):
            more, below = 3 * (faults[i] == "truncated"), best
            best = {}
            for q in after:
                ways = [(4, "D", q)]
                if faults[i] not in ("blank", "duplicate"):
                    ways.append((3 + more, "R", after[q]))
                    if (q, initials[i]) in kept:
                        ways.append((more, "K", initials[i]))
                best[q] = min((c + below[to][0], x + below[to][1]) for c, x, to in ways)
        for _ in range(4):
            best = {q: min(best[q], (3 + best[after[q]][0], "I" + best[after[q]][1])) for q in after}
    return best[""]


def plain_conversation(rows):
    """Contract columns of one conversation's rows (turn, role, text), damaged and in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, letters = plain_edits(faults, initials)
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    out, left = [], list(rows)
    for letter in letters:
        nxt = "assistant" if out and out[-1][0][0] == "u" else "user"
        if letter == "I":
            out.append((nxt, ""))
            continue
        _, role, text = left.pop(0)
        if letter != "D":
            out.append((role if letter == "K" else nxt, text))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, sha("\n".join(f"{r}:{x}" for r, x in out)))


def plain_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).digest()))


def got_conversations(df):
    names = [*conversations.COUNTS, "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


def test_auction_finds_the_first_of_the_cheapest():
    draw = random.Random(5)
    names = ["", "truncated", "blank", "duplicate"]
    for case in range(3000):
        n = draw.choice([0, 1, 2, 3, 7, 15, 16, 17, 31, 32, 33, 50])
        codes = draw.choices(range(conversations.END) if case % 2 else [0, 4, 8, 4, 8, 4, 8, 5, 9, 7, 12], k=n)
        rows = [conversations.CODES[c] for c in codes]
        assert conversations.cheapest(bytes(codes)) == plain_edits([names[f] for _, f in rows], [i or "x" for i, _ in rows])


def test_prices_are_feasible_and_exact_at_origins():
    codes = bytes(random.Random(1).choices(range(conversations.END), k=40)) + bytes([conversations.END])
    n = len(codes) - 1
    prices = [0] * (4 * (n + 1) + 1)
    conversations.auction(prices, codes, 0, 4 * (n + 1))
    arcs = [(v, v + step, cost) for v in range(4 * (n + 1)) for _, step, cost in conversations.ARCS[codes[v >> 2]][v & 3]]
    assert all(prices[v] <= cost + prices[w] for v, w, cost in arcs)
    assert prices[0] == conversations.cheapest(codes[:-1])[0]


def test_a_long_conversation():
    codes = bytes(random.Random(2).choices([4, 8, 5, 12, 7], k=3000))
    cost, letters = conversations.cheapest(codes)
    assert sum(letters.count(x) for x in "DKR") == 3000 and cost > 0


@with_data
def test_conversation_query(spark):
    table, rows = pd.read_parquet(f"{SF}/conversations.parquet"), defaultdict(list)
    for conv, turn, role, text in table[["conv_id", "turn", "role", "text"]].itertuples(index=False):
        h, own = zlib.crc32(f"{conv}:{turn}".encode()) % 20, rows[conv]
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    got = got_conversations(queries.op11_conversation_repair(spark, SF))
    assert got == {k: plain_conversation(plain_order(v)) for k, v in rows.items()}


ODD = [
    (1, None, "user", "Hi."), (1, 2, "assistant", "Yes"), (1, 2, "assistant", "Yes"), (1, 5, "user", None), (1, 9, None, "Why?"), (1, 9, "", "b."), (1, 9, "tool", "a."),
    (None, 1, "system", "Be good."), (None, None, "system", "Be good."), (2, 1, "assistant", "é" * 70000 + "."), (2, 1, "assistant", "é" * 70000 + "!"), (3, 1, " ", "\t\n"),
]


def test_odd_conversations(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("key", "head", "md5", "here", "audit", "begins", "code", "at")})
    rows = defaultdict(list)
    for conv, turn, role, text in ODD:
        rows[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = {k: plain_conversation(plain_order(v)) for k, v in rows.items()}
    assert got_conversations(conversations.digests(df)) == want
    none = conversations.digests(df, present=F.lit(False)).collect()
    assert len(none) == 4 and all(r["audit"] == "" and r["repaired_sha256"] == sha("") and r["cost"] == 0 for r in none)
    assert conversations.digests(df.limit(0)).count() == 0 and conversations.repaired(df.limit(0)).count() == 0
    turns = defaultdict(list)
    for r in conversations.repaired(df).orderBy("at").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(sha("\n".join(turns[k])) == v[-1] for k, v in want.items())


# lines


def plain_lines(rows, least=40, docs=5):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    order = lambda d: (d is not None, d or 0)
    gone = {k: max(v, key=order) for k, v in held.items() if len(k) >= least and len(v) >= docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines_rows():
    a, b, c = "A line that many documents share, word for word", "ünd eine Zeile von genau vierzig Zeichen", "short"
    rows = [(i, f"own line of document {i} that is long enough to count\n{a if i % 2 else '  ' + a.upper() + chr(9)}\n{c}\n{b if i < 4 else ''}") for i in range(7)]
    return [*rows, (7, None), (8, ""), (9, f"{a}\n{a}\n{b}\n\n"), (9, f"{b}\nx\n{a}"), (9, f"{a}\n{a}\n{b}\n\n"), (None, a + "\n" + c), (None, b), (10, "x" * 90000), (11, (a + "\n") * 2000)]


def test_lines(spark):
    assert len("ünd eine Zeile von genau vierzig Zeichen") == 40
    rows = lines_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("of", "gone", "found", "doc", "line", "hash", "kept", "n")})
    got = line_dedup.deduplicated(df).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got], key=repr) == plain_lines(rows)
    assert {r["gone"] for r in got} == {"x"} and line_dedup.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_full_filters_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "PART_BITS", bits)
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    monkeypatch.setattr(line_dedup, "PART_HASHES", 4)
    rows = lines_rows()
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got], key=repr) == plain_lines(rows)


def test_bloom_filter():
    hashes = np.random.default_rng(0).integers(1 << 63, size=20000, dtype=np.uint64)
    seen = line_dedup.Bloom(1 << 18, 4)
    seen.add(hashes[:10000])
    assert seen.holds(hashes[:10000]).all() and seen.holds(hashes[10000:]).mean() < 0.01


# runs


def plain_runs(x):
    found = {}
    for p in range(1, len(x) // 3 + 1):
        i = 0
        while i + p < len(x):
            if x[i] == x[i + p]:
                j = i
                while j + p < len(x) and x[j] == x[j + p]:
                    j += 1
                if j + p - i >= max(24, 3 * p):
                    found.setdefault((i, j + p), p)
                i = j
            i += 1
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def drawn(rng):
    n = int(rng.integers(0, 300))
    kind = rng.integers(0, 5)
    if kind == 0:
        return rng.integers(0, 2, n)
    if kind == 1:
        return np.tile(rng.integers(0, 5, rng.integers(1, 40)), 20)[:n]
    if kind == 2:
        words = [[0], [0, 1]]
        while len(words[-1]) < n + 1:
            words.append(words[-1] + words[-2])
        return np.array(words[-1][:n])
    if kind == 3:
        return np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 12)) for _ in range(5)])
    return rng.integers(0, 1000, n)


def test_runs_of_drawn_sequences():
    rng, n = np.random.default_rng(4), 0
    for seed in range(25):
        texts = [np.asarray(drawn(rng), np.int64) for _ in range(rng.integers(1, 20))]
        for x, got in zip(texts, periodic.runs_of(texts, seed), strict=True):
            assert got == plain_runs(x.tolist())
            n += len(got)
    assert n > 100


def test_grammar_extends_exactly():
    rng = np.random.default_rng(6)
    for _ in range(20):
        seq = np.append(np.asarray(drawn(rng), np.int64), 1 << 20)
        levels, firsts = periodic.recompressed(seq, rng, least=2)
        ahead = periodic.laid_out(levels, firsts, False)
        i = rng.integers(0, len(seq), 200)
        j = rng.integers(0, len(seq), 200)
        i, j = i[i != j], j[i != j]
        for a, b, n in zip(i, j, periodic.common(ahead, i, j), strict=True):
            want = 0
            while max(a, b) + want < len(seq) and seq[a + want] == seq[b + want]:
                want += 1
            assert n == want


@with_data
def test_runs_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, text in docs[["doc_id", "text"]].itertuples(index=False):
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = plain_runs(words), got[doc]
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_odd_texts(spark):
    long = " ".join(f"w{i % 7}" for i in range(50000))
    rows = [(1, None), (1, None), (None, ""), (2, " \t\n"), (3, "a " * 23), (4, "a\u00a0b " * 24), (7, "a b " * 24), (5, long), (6, "x" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("found", "start", "runs", "period")})
    got = periodic.with_runs(df).collect()
    runs = sorted([(r["doc_id"], [tuple(x) for x in r["runs"]], len(r["collapsed"])) for r in got], key=repr)
    want = [(1, [], 0), (1, [], 0), (None, [], 0), (2, [], 0), (3, [], 45), (4, [(0, 24, 1)], 3), (7, [(0, 48, 2)], 3), (5, [(0, 50000, 7)], 20), (6, [], 100000)]
    assert runs == sorted(want, key=repr) and got[0]["start"] == "x" and periodic.with_runs(df.limit(0)).count() == 0


# names that clash


def test_shards_keep_columns_of_any_name(spark):
    names = ("chunk", "n", "before", "number", "__chunk", "__n", "__before", "__number")
    df = spark.range(300).withColumnRenamed("id", "doc_id").withColumns({c: F.lit(c) for c in names})
    got = sharding.shards(df, "doc_id", [1.0] * 4).collect()
    assert all(r[c] == c for r in got for c in names) and set(names) <= set(got[0].asDict())
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {4}
