"""Lines that many documents share, dropped from all but one of them.

Every long enough line becomes a 64-bit hash. Hashes, one per document and at most one row per batch, go to the part
that holds their slice of two Bloom filters: one of hashes seen, one of hashes seen again. What the second takes up is
suspected. The suspected hashes set the bits of one more filter, which tasks get by broadcast and which never exceeds
2^28 bits: with more suspects more lines pass it, and the result is the same. Only lines that pass are shuffled, as a
SHA-256 of their key with the document's, to be counted exactly and to find the document that keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import Tables, fresh, met, on_workers, spread

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Hashes that a part's filters are made for, their bits, and the bits that a hash sets.
PART_HASHES, PART_BITS, PROBES = 1 << 20, 1 << 24, 4
#: Bits of the broadcast filter: so many a suspect, and never more than this.
SUSPECT_BITS, MOST_BITS = 16, 1 << 28
CODEC = "zstd"


def keys_of(text: bytes | None, least: int) -> Iterator[bytes]:
    """The keys of a text's lines that have `least` code points or more: lines without white space at their ends, A-Z in
    lower case."""
    for line in (text or b"").split(b"\n"):
        if len(line) >= least:
            key = line.strip(SPACES).lower()  # of bytes: ASCII letters only
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                yield key


def hashed(keys: Iterator[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(k) for k in keys]


def places(hashes: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    """The bits of a filter of `bits` bits, a power of two, that each hash sets."""
    step = (hashes >> np.uint64(31)) | np.uint64(1)
    for k in range(probes):
        yield ((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    def __init__(self, bits: int, probes: int, data: np.ndarray | None = None):
        self.bits, self.probes, self.data = bits, probes, np.zeros(max(bits // 8, 8), np.uint8) if data is None else data

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, self.bits, self.probes):
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def add(self, hashes: np.ndarray) -> None:
        for at in places(hashes, self.bits, self.probes):
            np.bitwise_or.at(self.data, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def sightings(df: DataFrame, text: str, least: int) -> DataFrame:
    """(hash, again): the hashes of lines, each once a document; a row for each in a batch, `again` where several documents
    of the batch have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for t in batch.column(0).cast(pa.binary()).to_pylist() for h in set(hashed(keys_of(t, least)))]
            one, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n > 1)], ["hash", "again"])

    return df.select(F.col(text)).mapInArrow(run, "hash bigint, again boolean")


def seen_again(rows: DataFrame, parts: int) -> DataFrame:
    """(hash): those of sightings that two documents may share, through two filters a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(PART_BITS, PROBES), Bloom(PART_BITS, PROBES)
        for batch in batches:
            every, again = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            one, first, n = np.unique(every, return_index=True, return_counts=True)
            several = (n > 1) | again[first] | once.holds(one)
            once.add(one)
            new = one[several]
            new = new[~twice.holds(new)]
            twice.add(new)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], ["hash"])

    return rows.repartition(parts, "hash").mapInArrow(run, "hash bigint")


def filter_of(suspects: DataFrame, n: int) -> Bloom:
    """The filter of n suspected hashes: two bits each, gathered as words of 64 bits, at most 2^22 of them."""
    bits = spread(1, 1, max(64, n * SUSPECT_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(places(batch.column(0).to_numpy().view(np.uint64), bits, 2))))
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    found = suspects.mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Bloom(bits, 2, words.view(np.uint8))


def suspected(text: Column, seen, least: int) -> Column:
    """The distinct SHA-256 of a text's keys whose hashes pass the broadcast filter `seen`."""

    @F.arrow_udf("array<binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [list(dict.fromkeys(keys_of(t, least))) for t in batch.cast(pa.binary()).to_pylist()]
            hits = iter(seen.value.holds(np.array([h for keys in found for h in hashed(iter(keys))], np.uint64)).tolist())
            yield pa.array([[hashlib.sha256(k).digest() for k in keys if next(hits)] for keys in found], pa.list_(pa.binary()))

    return run(text)


def without(text: Column, dropped: Column, least: int) -> Column:
    """struct(kept, n_lines, n_dropped) of a text without the lines whose keys have one of the digests `dropped`."""

    @F.arrow_udf("struct<kept: string, n_lines: bigint, n_dropped: bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, drops in batches:
            out = []
            for t, digests in zip(texts.cast(pa.binary()).to_pylist(), drops.to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                kept = lines
                if digests:
                    gone = set(digests)
                    kept = [x for x in lines if not any(hashlib.sha256(k).digest() in gone for k in keys_of(x, least))]
                out.append({"kept": b"\n".join(kept).decode(), "n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
            yield pa.array(out, pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    return run(text, dropped)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """The rows with `kept`, the text without shared lines, `n_lines`, how many it had, and `n_dropped` (replaced where they
    are there). A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of `least_chars`
    code points or more that `least_docs` documents hold lose all their lines but those of the largest document. Rows of
    one key column value are one document; a null one is one too, and the smallest. Null and empty texts are one empty
    line; a text that loses all its lines is empty. An empty table gives an empty table."""
    spark = df.sparkSession
    on_workers(spark)
    tables = Tables(spark, "lines")
    seen = tables.written(sightings(df, text, least_chars), "sightings", codec=CODEC)
    again = tables.written(seen_again(seen, spread(seen.count(), PART_HASHES)), "again", [seen], codec=CODEC)
    held = spark.sparkContext.broadcast(filter_of(again, again.count()))
    tables.drop(again)
    pairs = df.select(F.col(key).alias("doc"), F.explode(suspected(F.col(text), held, least_chars)).alias("line")).distinct()
    pairs = tables.written(pairs, "pairs", codec=CODEC)
    shared = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).where(F.col("n") >= least_docs)
    shared = tables.written(shared, "shared", codec=CODEC)
    drops = met(pairs, shared, "line", "n", pairs.count()).where(~F.col("doc").eqNullSafe(F.col("last")))
    of, gone, found = fresh(df, "of", "gone", "found")
    drops = drops.groupBy(F.col("doc").alias(of)).agg(F.collect_list("line").alias(gone))
    rows = df.join(drops, df[key].eqNullSafe(drops[of]), "left").drop(of)
    rows = rows.withColumn(found, without(F.col(text), F.col(gone), least_chars))
    return rows.withColumns({c: F.col(found)[c] for c in ("kept", "n_lines", "n_dropped")}).drop(found, gone)
