"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing names, and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from contactloom.llm import bpe, fingerprints, hamming, languages, mixing, near_dedup, sharding, token_counts, token_ids, toxicity, varbytes
from contactloom.llm.common import scratch

LONG = "the cat sat on the mat and " * 9000 + "end"
TEXTS = [
    (1, "one two three four five six seven", "a"),
    (1, "one two three four five six seven", "a"),
    (2, "", "a"),
    (3, None, None),
    (None, "null key here", "b"),
    (4, " \t\n ", "b"),
    (5, "½ ² €\x85 x ퟿ ﬁ é 日本語", "b"),
    (6, LONG, "b"),
    (7, "One Two three four five six seven", "c"),
    (8, "x" * 5000, "c"),
    (9, "<|endoftext|> inside  of   it", "c"),
    (1, "another text of key one", "c"),
]
SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with what operators make
    extra = {c: F.lit("kept") for c in ("size", "shard", "slot", "score", "node", "n", "ids", "value", "draws", "start")}
    return spark.createDataFrame(TEXTS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_token_counts(spark, docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.with_token_counts(docs, path).collect()
    assert texts(got, "doc_id", "n_tokens") == sorted([(k, len(sp.encode(t or ""))) for k, t, _ in TEXTS], key=repr)
    assert got[0]["score"] == "kept"
    assert token_counts.with_token_counts(none, path).count() == 0


def test_pieces_join_to_the_text():
    for text in (LONG, "a" * 3000, "a  b " * 900, "a ▁ b ▁" * 500):
        assert " ".join(token_counts.pieces(text, 64)) == text


@pytest.mark.parametrize("end", [None, 2])
def test_token_ids(spark, docs, none, end):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    folder = scratch(spark, "test")
    token_ids.write(docs, folder, path, end)
    got = token_ids.read(spark, folder).collect()
    want = [(k, np.array(tok.encode(t or "", add_special_tokens=False).ids + ([end] if end else []), "<u4").tobytes()) for k, t, _ in TEXTS]
    assert texts([{"k": r["doc_id"], "i": bytes(r["ids"])} for r in got], "k", "i") == sorted(want, key=repr)
    got.sort(key=lambda r: (r["start"], len(r["ids"])))
    assert [r["doc_id"] for r in got][0] is None
    assert [r["start"] for r in got] == np.cumsum([0, *[len(r["ids"]) // 4 for r in got]])[:-1].tolist()
    token_ids.write(none, f"{folder}-none", path, end)
    assert token_ids.read(spark, f"{folder}-none").count() == 0


def test_varbytes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (varbytes.decode(*varbytes.encode(v), n) == v).all()
    control, data = varbytes.encode(np.array([1, 256, 65536, 1 << 24], np.uint32))
    assert control == bytes([0b11100100]) and len(data) == 10


def test_bpe(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, block_chars=4000)
    got = out.withColumn("decoded", bpe.decoded(F.col("ids"), path)).collect()
    enc = bpe.merges(path)
    want = [(k, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t, _ in TEXTS]
    assert texts([{"k": r["doc_id"], "i": bytes(r["ids"]), "d": bytes(r["decoded"])} for r in got], "k", "i", "d") == sorted(want, key=repr)
    assert bpe.encode(none, path).count() == 0


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans(near_dedup.UPPER, near_dedup.LOWER)))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    want = []
    for k, t, _ in TEXTS:
        s = shingles(t)
        linked = [j for j, u, _ in TEXTS if s and 100 * len(s & shingles(u)) >= 85 * len(s | shingles(u)) and j is not None]
        least = min(linked, default=None) if s else k
        want.append((k, len(s), least, least == k))
    assert texts(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert texts(kept.collect(), "doc_id", "text") == sorted({(k, t) for k, t, _ in TEXTS if k != 7}, key=repr)


def test_near_duplicates_chains_and_groups(spark):
    """Links that only a chain or a list's lesser members show; compared with all pairs."""
    rng = np.random.default_rng(3)
    rows, base = [], [f"w{i}" for i in rng.integers(0, 500, 120)]
    for g in range(6):
        text = list(base) if g < 3 else [f"v{g}{i}" for i in rng.integers(0, 300, 60)]
        for _ in range(30):
            if rng.random() < 0.7:
                text[int(rng.integers(len(text)))] = f"e{int(rng.integers(10**6))}"
            copy = list(text)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = f"n{int(rng.integers(10**6))}"
            rows.append((len(rows), " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i in sets}
    assert 6 < len({root(i) for i in sets}) < len(rows)


def test_sharding(spark, docs, none):
    weights = [1.0, 2.0, 5.0]
    got = sharding.shards(docs, "doc_id", weights, content="text").collect()
    assert len(got) == len(TEXTS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.shards(none, "doc_id", weights).count() == 0
    many = sharding.shards(spark.range(20000), "id", weights).groupBy("shard").count().collect()
    assert all(abs(r["count"] / 20000 - weights[r["shard"]] / 8) < 0.02 for r in many)


def test_mixing(spark, docs, none):
    got = mixing.mix(docs.drop("size"), mixing.word_count(F.col("text")), shards=3).collect()
    sizes = {None: 0}
    for k, t, s in TEXTS:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    assert {(r["source"], r["source_size"]) for r in got} == set(sizes.items())
    for s, n in sizes.items():
        rows = [r for r in got if r["source"] == s]
        taken = sum(r["size"] * len(r["draws"]) for r in rows)
        assert abs(taken - rows[0]["target"]) <= max(r["size"] for r in rows) and rows[0]["target"] <= 3 * n
    assert mixing.mix(none, mixing.word_count(F.col("text"))).count() == 0


def test_targets_share_what_is_above_the_cap(spark):
    rows = [("a", 100, 1, 1), ("b", 10, 2, 2), ("c", 50, 3, 3)]
    got = mixing.targets(spark.createDataFrame(rows, "s string, source_size long, weight int, __rank int")).collect()
    t = {r["s"]: r["target"] for r in got}
    assert t["b"] == 30 and abs(t["c"] - 3 * t["a"]) < 1e-9 and abs(sum(t.values()) - 160) < 1e-9


def test_splitting_tree_keeps_quotas_and_means(spark):
    quotas = spark.createDataFrame([([1000, 0, 37, 3],)], "quotas array<bigint>")
    leaves = mixing.splitting_tree(quotas, 5, 1).collect()
    assert np.sum([r["quotas"] for r in leaves], axis=0).tolist() == [1000, 0, 37, 3]
    assert {sum(r["quotas"]) for r in leaves} == {208}
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(40).cast("long"), mixing.unit(F.xxhash64("id"))).alias("x"))
    mean, var = draws.agg(F.avg("x"), F.variance("x")).first()
    assert abs(mean - 12) < 0.15 and abs(var - 40 * 0.3 * 0.7 * 60 / 99) < 0.5


def test_fingerprints(spark, docs, none):
    got = docs.select("doc_id", "text", fingerprints.hexed(fingerprints.fingerprint(F.col("text"))).alias("p")).collect()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["p"]) == r["p"]
        assert len(r["p"]) == (fingerprints.BINS * fingerprints.LOW_BITS // 4 if WORD.findall(r["text"] or "") else 0)
    assert none.select(fingerprints.fingerprint(F.col("text"))).count() == 0
    words = [f"w{i}" for i in range(600)]
    pairs = [(" ".join(words[:n]), " ".join(words[:n] if n == m else words[m:])) for n, m in ((600, 600), (600, 100), (400, 300), (30, 10), (3, 3), (100, 300))]
    frame = spark.createDataFrame(pairs, "a string, b string")
    est = frame.select("a", "b", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("x")).collect()
    for r in est:
        a, b = shingles(r["a"]), shingles(r["b"])
        assert abs(r["x"] - len(a & b) / len(a | b)) < 0.12


def test_next_document_over_parts(spark):
    rows = [(i * 7 % 101, f"t{i * 7 % 101}") for i in range(101)] + [(None, "null")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", {}, rows_per_part=5).collect()
    order = [None if k < 0 else k for k in range(100, -2, -1)]
    want = {k: "null" if n is None else f"t{n}" for k, n in zip(order, order[1:] + order[:1])}
    assert {r["doc_id"]: r["next_text"] for r in got} == want
    one = fingerprints.with_next(spark.createDataFrame([(1, "self")], "doc_id long, text string"), "doc_id", "text", {})
    assert one.first()["next_text"] == "self"


def test_hamming(spark):
    rng = np.random.default_rng(1)
    codes = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 300), np.full(40, 5), [5 ^ (1 << i) for i in range(20)]]).astype(np.int64)
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(999, None), (0, int(codes[0]))]
    frame = spark.createDataFrame(rows, "id long, code long")
    got = hamming.nearest(frame, frame.where("id % 30 = 0"), k=4).collect()
    d = lambda a, b: bin((int(codes[a]) ^ int(codes[b])) & (2**64 - 1)).count("1")
    want = set()
    for q in range(0, len(codes), 30):
        for n, (x, i) in enumerate(sorted((d(q, i), i) for i in range(len(codes)) if i != q)[:4]):
            want.add((q, n + 1, i, x))
    assert {(r["query"], r["rank"], r["id"], r["distance"]) for r in got} == want
    assert hamming.nearest(frame.limit(0), frame.limit(0)).count() == 0
    few = frame.where("id < 2")
    assert hamming.nearest(few, few, k=10).count() == 2


def test_models_without_labels(spark, docs, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model is None
    assert {r["score"] for r in toxicity.with_scores(docs, model).collect()} == {0.0}
    field = languages.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert field is None
    assert {r["lang_pred"] for r in languages.labelled(docs, field).collect()} == {"und"}
    field = languages.fit(most_bytes=1 << 20, docs=docs.withColumn("lang", F.when(F.col("doc_id") == 6, "en").otherwise("xx")))
    got = {(r["doc_id"], r["text"]): r for r in languages.labelled(docs, field).collect()}
    assert got[3, None]["lang_pred"] == got[2, ""]["lang_pred"] == "und" and got[6, LONG]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert languages.labelled(none, field).count() == 0


def test_digests(spark, docs):
    row = docs.where("doc_id = 9").select(F.crc32("text").alias("c"), F.sha2("text", 256).alias("s")).first()
    assert row["c"] == zlib.crc32(TEXTS[10][1].encode()) and row["s"] == hashlib.sha256(TEXTS[10][1].encode()).hexdigest()


@pytest.mark.parametrize("key", ["start", "ids", "decoded", "IDS"])
def test_keys_called_as_what_operators_add(spark, docs, key):
    plain = docs.select(F.col("doc_id").alias(key), "text")
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, f"keys-{key}")
    token_ids.write(plain, folder, path, 2, key=key)
    got = token_ids.read(spark, folder, key=key)
    assert got.columns == [key, *[c + "_" * (c == key.lower()) for c in ("start", "ids")]]
    token_ids.write(docs.select("doc_id", "text"), f"{folder}-plain", path, 2)
    want = token_ids.read(spark, f"{folder}-plain").collect()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want)))
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode(plain, ranks, key=key, decode=True)
    assert got.columns == [key, *[c + "_" * (c == key.lower()) for c in ("ids", "decoded")]]
    want = bpe.encode(docs.select("doc_id", "text"), ranks, decode=True)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
