"""The numbered queries: each applies its operator to the whole table it is for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import bpe, conversations, fingerprints, hamming, languages, line_dedup, mixing, near_dedup, periodic, sharding, token_counts, token_ids, toxicity
from contactloom.llm.common import Tables, let, scratch, table, words


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; null is empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return out.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, learned from labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~held_out))
    out = toxicity.with_scores(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every row whose id is divisible by 100, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    out = hamming.nearest(rows, rows.where("id % 100 = 0"), k=10)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "distance")


#: Brute force: signs compared one by one.
OP3_SQL = """
WITH signs AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.s, r.s), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM signs q JOIN signs r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the token-id files of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "token-ids")
    token_ids.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    out = token_ids.read(spark, folder)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates, from 85 percent on."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs that share a shingle, then what each document can reach.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM starts),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, steps.b FROM reach JOIN steps ON steps.a = reach.r),
lowest AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    field = languages.fit(docs.where(~held_out))
    out = languages.labelled(docs.select("doc_id", "text"), field)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards by the document's key; a 25th takes rows only into itself."""
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size")
    rows = docs.select("doc_id", size, F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = sharding.shards(rows, "doc_id", [1.0] * 24, content="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    docs = Tables(spark, "op9").written(docs, "sizes")  # texts are read once
    out = mixing.mix(docs, F.col("size"), content="hash")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form, and their likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprints.with_next(docs, "doc_id", "text", {"print": fingerprints.fingerprint})
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprints.edited(F.col("text"), F.col("next_text")).alias("edited"), "print", "next_print")
    docs = docs.withColumn("edited_print", fingerprints.fingerprint(F.col("edited")))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.hexed(F.col("print")).alias("fingerprint"),
        fingerprints.hexed(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprints.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults, and `there`, false for those that are dropped."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    role = F.when(h == 4, "user").otherwise(or_space("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h != 0).alias("there"), F.explode(F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1))))
    return rows.drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest edits of every conversation, after planted damage."""
    return conversations.digests(damaged(table(spark, sf_dir, "conversations")), present=F.col("there"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the lines that five documents share."""
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: Shared lines by counting all keys.
OP12_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS dropped FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def planted(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, by doc_id, periodic from some word on."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def of(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when((h % 10 == 0) & (F.size(words(text)) > 0), let(words(text), of)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole text, some of which are made periodic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    rows = periodic.with_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed", F.octet_length("text").alias("n_bytes"))
    start, period, length = -F.col("b.s"), -F.col("b.p"), F.col("b.n")
    return rows.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"),  # a second use of the text keeps it a column of its own below the function
    )


NUMBERED = (
    op1_token_counts, op2_toxicity, op3_topk_search, op4_token_ids, op5_near_dedup, op6_byte_bpe, op7_languages, op8_sharding, op9_mixing, op10_fingerprints,
    op11_conversation_repair, op12_line_dedup, op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NUMBERED}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": OP3_SQL, "op5_near_dedup": OP5_SQL, "op12_line_dedup": OP12_SQL}
