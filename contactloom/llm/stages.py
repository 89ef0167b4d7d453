"""The stages of the corpus pipeline: each takes documents and gives what it keeps of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import bpe, languages, mixing, near_dedup, toxicity
from contactloom.llm.common import Tables, fresh, small, spread, table

#: Below this a text has no language that stands out.
LEAST_SHARE = 0.35
#: Percent of five-word shingles that near-duplicates share; op5's own level is 85.
LEAST_SIMILAR = 80
#: Rows of one run of the mix's order, which one task writes.
RUN_ROWS = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; learned from the labels as op2 does."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    (score,) = fresh(docs, "score")
    return toxicity.with_scores(docs, model, out=score).where(F.col(score) < toxicity.LEVEL).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or no language that stands out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    field = languages.fit(docs.where(~held_out))
    found = languages.labelled(docs.select(F.struct(*docs.columns).alias("row"), "text"), field)
    return found.where((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by similarities from 0.8 on."""
    return near_dedup.deduplicated(docs, percent=LEAST_SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in runs of its shuffled order. The mix is decided on keys, sizes and
    hashes, and texts meet its draws once. Of rows alike in key, source and text the first stands for the others."""
    tables, same = Tables(spark, "mixed"), ["doc_id", "source", "hash"]
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    sizes = tables.written(sizes, "sizes")
    several = not sizes.where("size > 0").groupBy(*same).count().where("count > 1").isEmpty()
    drawn = mixing.mix(sizes, F.col("size"), content="hash").select(*same, F.explode("draws").alias("d"))
    drawn = drawn.groupBy(*[F.col(c).alias(f"of_{c}") for c in same]).agg(F.collect_list("d").alias("draws"))
    drawn = tables.written(drawn, "drawn", [sizes])  # three draws a row at most
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("hash"))
    rows = rows.dropDuplicates(same) if several else rows
    met = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in same]
    rows = rows.join(small(drawn), met[0] & met[1] & met[2]).select("row", F.explode("draws").alias("d")).select("row", "d.shard", "d.order")
    runs = spread(docs.count(), 16 * RUN_ROWS)  # of each shard
    run = F.shiftrightunsigned("order", 65 - runs.bit_length()) if runs > 1 else F.lit(0)
    return rows.repartition(16 * runs, "shard", run).sortWithinPartitions("shard", "order").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
