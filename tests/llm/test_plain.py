"""Operators without SQL against plain versions, and every numbered query and stage on whole tables."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from contactloom.llm import common, compression, crf, fingerprints, mixing, near_dedup, queries, stages, toxicity

SF = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def rows_of(spark, name):
    return queries.queries()[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)


# forward-backward


def enumerated(e, transitions, start):
    """Word by language probabilities from all labellings of one chain."""
    n, k = e.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = math.exp(start[labels[0]] + sum(e[t, y] for t, y in enumerate(labels)) + sum(transitions[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        out[np.arange(n), labels] += w
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_is_the_sum_over_labellings():
    rng = np.random.default_rng(0)
    transitions, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([1, 4, 6])
    e = rng.normal(size=(3, 6, 3))
    p, _ = crf.forward_backward(e, lengths, transitions, start)
    for c, n in enumerate(lengths):
        assert np.allclose(p[c, :n], enumerated(e[c, :n], transitions, start)) and not p[c, n:].any()


def test_blocks_of_a_text_are_one_chain(monkeypatch):
    languages = ["de", "en", "fr"]
    rng = np.random.default_rng(1)
    texts = [(" ".join("".join(rng.choice(list(letters), 4)) for _ in range(60)), y) for y, letters in zip(languages, ("aeiku", "orstn", "lmécp"), strict=True) for _ in range(6)]
    field = crf.fit(texts, chains=60, rounds=8)
    mixed = [" ".join(t for t, _ in texts), texts[0][0], "", "12 34", texts[3][0] + " " + texts[16][0]]
    whole, counts = crf.Labeller(field).shares(mixed)
    monkeypatch.setattr(crf, "BLOCK", 7)
    parts, same = crf.Labeller(field).shares(mixed)
    assert (counts == same).all() and np.allclose(whole, parts)
    assert counts[2] == counts[3] == 0


# compression


def test_gains_are_the_differences_of_window_lengths():
    gains = compression.Gains(b" common words of plain text again ", b" rotten scoundrel again ")
    words = compression.windows_of("Common words, ROTTEN scoundrel! again é")
    assert words == [b"common", b"words", b"rotten", b"scoundrel", b"again", "é".encode()]
    got = gains.of(words)
    one, two = gains.compressors()
    assert got.tolist() == [len(one.compress(b" " + w + b" " + compression.TAIL)) - len(two.compress(b" " + w + b" " + compression.TAIL)) for w in words]
    assert got[2] > 0 and got[3] > 0 and got[0] < 0 and got[4] == 0
    kept = compression.Scorer(gains, most=2)
    x = kept.features([words, [], words[2:4]])
    plain = compression.features(np.concatenate([got, got[2:4]]), np.array([0] * 6 + [2] * 2), 3)
    assert np.array_equal(x, plain) and not x[1].any() and np.array_equal(kept.features([words, [], words[2:4]]), plain)


def test_toxic_dictionary_is_trained_on_what_ordinary_texts_lack():
    """The trainer keeps whole windows that come back in toxic texts, in front or behind, and none that both kinds have."""
    words = [b"plain", b"words", b"rotten", b"scoundrel", b"vermin", b"wretched", b"once"]
    rng = np.random.default_rng(3)
    toxic = [np.concatenate([rng.integers(0, 2, 30), rng.integers(2, 6, 2)]) for _ in range(200)] + [np.array([6])]
    ordinary = [rng.integers(0, 2, 30) for _ in range(200)]
    found = compression.contrasted(toxic, ordinary, words, 4096, 4, 0.1)
    assert all(b" " + w + b" " in found for w in words[2:6])
    assert not any(w in found for w in (b"plain", b"words", b"once")) and compression.APART not in found
    assert found == compression.contrasted(toxic, ordinary, words, 4096, 4, 0.1)
    few = compression.contrasted(toxic[:5], ordinary, words, 4096, 1, 0.1)  # too few to train on
    assert few and all(any(words[i] in few for i in t.tolist() if i > 1) for t in toxic[:5])
    assert compression.contrasted([], [], [], 4096, 4, 0.1) == b""


def test_dictionary_pieces_come_from_all_texts():
    """Beyond the bound, pieces of the last text are as likely as those of the first."""
    texts = [b"".join(b"%05d " % ((i * 7919 + k * 104729) % 99991) for k in range(300)) for i in range(60)]
    total = sum(map(len, texts))
    own = compression.trained(1 << 20, texts, total, total)
    part = compression.trained(1 << 20, texts, total, total // 4)  # too little for its size: the pieces themselves
    assert len(own) == total and total // 8 < len(part) < total // 2
    halves = [sum(t[i : i + 256] in part for t in side for i in range(0, len(t), 256)) for side in (texts[:30], texts[30:])]
    assert min(halves) > max(halves) / 2


def test_logistic_weights_are_stationary():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2, 0] + rng.normal(size=200) > 0).astype(float)
    w = compression.logistic(x, y, ridge=0.01)
    full = np.concatenate([x, np.ones((200, 1))], axis=1)
    assert np.allclose(full.T @ (1 / (1 + np.exp(-full @ w)) - y) / 200 + 0.01 * w, 0, atol=1e-6)


@with_data
def test_toxicity_on_held_out_texts(spark):
    """0.80 and more of the labelled toxic texts that the model hasn't seen, with few others."""
    sf = SF.replace("0.001", "0.1")
    got = queries.op2_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got["held_out"]]
    caught = held[held["toxic"] == 1]["predicted"].mean()
    right = held[held["predicted"] == 1]["toxic"].mean()
    assert caught >= 0.8 and right >= 0.9, (caught, right)


# sharding


@with_data
def test_sharding_is_plain_rendezvous(spark, docs):
    got = rows_of(spark, "op8_sharding")

    def won(key, n):
        unit = lambda i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min(range(n), key=lambda i: (-math.log(unit(i)), i))

    assert got["doc_id"].tolist() == docs["doc_id"].tolist()
    assert got["shard"].tolist() == [won(k, 24) for k in docs["doc_id"]]
    assert got["grown_shard"].tolist() == [won(k, 25) for k in docs["doc_id"]]
    raw = [(t or "").encode() for t in docs["text"]]
    assert got["size"].tolist() == [len(t) + 8 for t in raw] and got["text_crc32"].tolist() == [zlib.crc32(t) for t in raw]
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got["law"]) == {"key"}


# mixing


def shared_out(sizes, weights, repeats):
    """Targets by setting aside, one after the other, the sources whose cap the rest's share reaches."""
    left, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if repeats * sizes[i] <= share * weights[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = repeats * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


@with_data
def test_mixing_meets_plain_targets(spark, docs):
    got = rows_of(spark, "op9_mixing")
    size = docs["text"].map(lambda t: len(WORD.findall(t or "")))
    assert got["size"].tolist() == size.tolist()
    sources = sorted(docs["source"].dropna().unique(), key=lambda s: s.encode())
    sources += [None] * bool(docs["source"].isna().any())
    own = [int(size[docs["source"].isna() if s is None else docs["source"] == s].sum()) for s in sources]
    want = dict(zip(sources, shared_out(own, [(1, 2, 3)[i % 3] for i in range(len(own))], 3), strict=True))
    assert np.allclose(got["target"], docs["source"].map(want))
    assert (got["taken"] <= 3 * got["size"]).all()
    taken = got.groupby(docs["source"])["taken"].sum()
    assert all(abs(taken[s] - want[s]) <= max(1, 0.02 * want[s]) for s in sources if s is not None)  # ten documents a source
    assert rows_of(spark, "op9_mixing")["taken"].tolist() == got["taken"].tolist()


def test_mixing_fills_up_after_a_huge_document(spark):
    rows = [("a", i, n) for i, n in enumerate([9000, *[30] * 200])] + [("b", 1000 + i, 100) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, doc_id long, size long").selectExpr("*", "doc_id AS h")
    from pyspark.sql import functions as F

    out = mixing.mix(df, F.col("size"), content="h", weights=(1, 1)).toPandas()
    taken = (out["size"] * out["draws"].map(len)).groupby(out["source"]).sum()
    target = out.groupby("source")["target"].first()
    assert (abs(taken - target) <= 30).all() and out["draws"].map(len).max() <= 3


def test_mixing_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    names = ["__n", "__hash", "__s", "h", "chunk", "sum", "times", "f_source", "__source"]
    df = spark.createDataFrame([(i, "x", *["v"] * len(names)) for i in range(20)], ["doc_id", "source", *names])
    out = mixing.mix(df, F.lit(3).cast("long"), content="h")
    assert set(out.columns) == {"doc_id", "source", *names, "size", "source_size", "target", "draws"}
    assert out.count() == 20 and {r["__n"] for r in out.collect()} == {"v"}


# fingerprints


def words_hashed(text):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]

    def chained(run):
        seed = 42
        for v in run:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return signed(seed)

    return {chained(h[i : i + 5]) for i in range(max(1, len(h) - 4))} if h else set()


def plain_print(text):
    """Bins of the top bits with their smallest hash; an empty one probes all bins in its order."""
    bins = {}
    for v in words_hashed(text):
        b = ((v & (1 << 64) - 1) >> 56) ^ 128  # bins stand in the order of signed numbers
        bins[b] = min(v, bins.get(b, v))
    if not bins:
        return ""
    low = [bins[i if i in bins else next(b for b in fingerprints.probe_order(i) if b in bins)] & 255 for i in range(256)]
    return "".join(f"{sum(x << 8 * j for j, x in enumerate(low[k : k + 8])):016X}" for k in range(0, 256, 8))


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(bytes.fromhex(a)[i] == bytes.fromhex(b)[i] for i in range(256)) / 256
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


@with_data
def test_fingerprints_are_one_permutation_minhash(spark, docs):
    got = rows_of(spark, "op10_fingerprints")
    text = [t or "" for t in docs["text"]]
    after = [text[i - 1] for i in range(len(text))]  # the next by descending doc_id; after the last the first
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(text, after, strict=True)]
    assert got["n_chars"].tolist() == [len(t) for t in text]
    assert got["edited_sha256"].tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    prints, changed = [plain_print(t) for t in text], [plain_print(t) for t in edited]
    assert got["fingerprint"].tolist() == prints and got["edited_fingerprint"].tolist() == changed
    assert np.allclose(got["near_edited"], [plain_likeness(a, b) for a, b in zip(prints, changed, strict=True)])
    assert np.allclose(got["near_next"], [plain_likeness(prints[i], prints[i - 1]) for i in range(len(prints))])


# near-duplicates


def plain_classes(texts, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(texts)))
    find = lambda i: i if least[i] == i else find(least[i])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            least[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_with_hot_classes(spark, percent):
    """Thousands of exact copies, a chain of near copies and a hub, all against all pairs of distinct texts."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(12):
        base = list(base)
        base[int(rng.integers(120))] = word()
        texts.append(" ".join(base))
    hub = [word() for _ in range(150)]
    texts += [" ".join([*hub[:i], word(), *hub[i + 1 :]]) for i in range(0, 150, 8)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)] + ["", None, "one", "ONE"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3].upper()) for i in range(3000)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    want = plain_classes(texts, percent)
    assert [got[i] for i in range(len(texts))] == want and {got[1000 + i] for i in range(3000)} == {want[3]}


def test_equal_first_hashes_are_told_apart(spark, monkeypatch):
    """With a first hash that is the same for all sets, the second keeps them apart."""
    from pyspark.sql import functions as F

    real = near_dedup.summary
    monkeypatch.setattr(near_dedup, "summary", lambda text: common.let(real(text), lambda s: F.struct(s["n"].alias("n"), F.lit(7).cast("long").alias("node"), s["other"].alias("other"), s["sketch"].alias("sketch"))))
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (3, "a b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_deduplicated_keeps_columns_of_any_name(spark):
    names = ["__n", "__most", "__key", "__s", "__node", "k", "times", "s", "node"]
    df = spark.createDataFrame([(i, "a b c d e f g", *["v"] * len(names)) for i in (3, 1, 1)] + [(9, None, *["v"] * len(names))], ["doc_id", "text", *names])
    out = near_dedup.deduplicated(df).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 9] and set(out[0].asDict()) == {"doc_id", "text", *names}


# every numbered query, and the stages

COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op2_toxicity": "doc_id held_out score predicted",
    "op4_token_ids": "doc_id start n_tokens ids_crc32",
    "op5_near_dedup": "doc_id n_shingles component_id kept",
    "op6_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_languages": "doc_id held_out lang_pred score",
}


@with_data
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_gives_a_row_a_document(spark, docs, name):
    got = rows_of(spark, name)
    assert got.columns.tolist() == COLUMNS[name].split() and got["doc_id"].tolist() == docs["doc_id"].tolist()
    if name == "op6_byte_bpe":
        assert got["decoded_sha256"].tolist() == [hashlib.sha256((t or "").encode()).hexdigest() for t in docs["text"]]
    if name == "op4_token_ids":
        assert got["start"].tolist() == (got["n_tokens"].cumsum() - got["n_tokens"]).tolist()
    if name == "op7_languages":
        held = got["held_out"] & docs["lang"].notna() & (got["lang_pred"] != "und")
        assert (got["lang_pred"] == docs["lang"])[held].mean() > 0.9
    if "score" in got:
        assert got["score"].between(0, 1).all()


def test_pipeline_has_its_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "bpe"]


@with_data
def test_stages_follow_each_other(spark, docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(rows, spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(doc_id as string)) % 3 != 1"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_scores(rows.select("doc_id", "text"), model).collect()}
    clean = stages.drop_toxic(spark, rows, SF)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, v in scores.items() if v < 0.7) and clean.columns == rows.columns
    spoken = stages.drop_unknown_language(spark, rows, SF)
    left = {r["doc_id"] for r in spoken.collect()}
    assert spoken.columns == rows.columns and not left & set(docs[docs["text"].map(lambda t: not re.search(r"[^\W\d_]", t or ""))]["doc_id"])
    single = stages.drop_near_duplicates(spark, rows, SF)
    text = [t for t in docs["text"]]
    found = plain_classes(text, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == [int(k) for i, k in enumerate(docs["doc_id"]) if found[i] == i]


@with_data
def test_mixing_stage_repeats_rows_as_the_mix_takes_them(spark, docs):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).union(spark.createDataFrame([(-1, "x y z", "en", "src0", 5)] * 3 + [(-2, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = common.Tables(spark, "t").written(rows, "rows")
    mixed = stages.mix_sources(spark, rows, SF)
    sizes = rows.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    want = mixing.mix(sizes, F.col("size"), content="hash").select("doc_id", F.size("draws").alias("n")).collect()
    count = Counter()
    for r in want:
        count[r["doc_id"]] += r["n"]
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == rows.columns and {k: n for k, n in count.items() if n and k != -1} == {k: n for k, n in got.items() if k != -1}
    assert got[-1] == count[-1]


@with_data
def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(len(r["ids_sha256"]) == 64 for r in out)
