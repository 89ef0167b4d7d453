"""Token ids as files: frequency-ranked ids in variable-length bytes.

Texts are encoded once and the ids kept in the shared scratch folder. Ids are counted in the same tasks and ranked over
the corpus, so that the 256 most frequent take one byte. Documents are dealt by key range, sorted, and written in
blocks: Parquet files whose rows are blocks (part, block, start within the part, keys, lengths, control bytes, data
bytes) beside the table of ids by rank. A document starts at a control byte of its own. Reading adds up the parts' ids,
decodes block by block, and gives a row a document.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.llm import varbytes
from contactloom.llm.common import Tables, beside, cut_points, on_workers, part_of
from contactloom.llm.pretokens import WordIds, is_even, piece_tokens, pieces, ranges, sums

#: Characters that one round of encoding takes, and ids that a block holds (a longer document is a block).
BATCH_CHARS = 1 << 23
BLOCK_IDS = 1 << 18
#: Rows of a part, a range of keys in the files.
PART_ROWS = 2000


class Encoder:
    """The library's ids of whole texts. Plain texts are cut before spaces, each distinct piece of a batch into words, and
    each new word goes once through the library's model; other texts, and those with a special token's string, go whole
    through the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.by_word = self.whole.normalizer is None and isinstance(self.whole.pre_tokenizer, pre_tokenizers.ByteLevel) and not self.whole.pre_tokenizer.add_prefix_space
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        moved = [b for b in range(256) if b not in set(kept)]
        self.table = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self.space = self.table[32]
        self.words = WordIds(self.of_words, np.uint32)

    def of_words(self, words: list[str]) -> list[list[int]]:
        one, space, table = self.whole.model.tokenize, self.space, self.table
        spelled = (space + w[1:] if w[0] == " " and w.isascii() and w[1:].isalpha() else w.encode().decode("latin-1").translate(table) for w in words)
        return [[t.id for t in one(w)] for w in spelled]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        texts = pc.fill_null(texts, "")
        even = is_even(texts) if self.by_word else pa.array([False] * len(texts))
        for s in self.special:
            even = pc.and_not(even, pc.match_substring(texts, s))
        found, counts = pieces(texts.filter(even))
        coded = found.dictionary_encode()  # so that Python sees each piece of the batch once
        gc.disable()  # the lists made here hold no cycles, and there are very many of them
        try:
            flat, n = self.words.ids(piece_tokens(coded.dictionary))
        finally:
            gc.enable()
        at = coded.indices.to_numpy()
        flat, counts = flat[ranges((np.cumsum(n) - n)[at], n[at])], sums(n[at], counts)
        even = even.to_numpy(zero_copy_only=False)
        if even.all():
            return flat, counts
        own = iter(np.split(flat, np.cumsum(counts)[:-1]))
        each = [next(own) if e else np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for e, t in zip(even, texts.to_pylist(), strict=True)]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, one row at least."""
    sizes = np.diff(np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1])
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(values):
        yield at, len(values)


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An array of binaries, the counts in items of `flat`."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def width_of(path: str, end_id: int | None) -> str:
    """The numpy type that holds every id."""
    return "<u2" if max(encoder(path).whole.get_vocab_size(), end_id or 0) < 1 << 16 else "<u4"


def encoded(df: DataFrame, path: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, ids, counts): keys, and ids as little-endian unsigned integers of `width_of`, with `end_id` after each
    document's. Null text is empty; rows keep their order and number. Each task ends with a row that has no ids, and how
    often the task had each id as 64-bit integers."""
    on_workers(df.sparkSession)
    width = width_of(path, end_id)
    names = ["k", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total, kind = encoder(path), np.zeros(0, np.int64), None
        for batch in batches:
            texts, kind = batch.column(1), batch.column(0).type
            for a, b in chunks(texts, BATCH_CHARS):
                flat, counts = enc.ids(texts.slice(a, b - a))
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(counts), end_id)
                    counts = counts + 1
                got = np.bincount(flat, minlength=len(total))
                got[: len(total)] += total
                total = got
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), binaries(flat.astype(width), counts).cast(pa.binary()), pa.nulls(b - a, pa.binary())], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids binary, counts binary")


def ranked_ids(counts: DataFrame) -> DataFrame:
    """(id, n, rank) from the tasks' counts: ids of the corpus by falling count, then by id; as many rows as the vocabulary
    has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                n = np.frombuffer(packed, "<i8")
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found], pa.int64())], ["id", "n"])

    total = counts.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return total.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), "id")) - 1)


def write(df: DataFrame, folder: str, path: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encodes the texts and writes `folder`/ids (blocks in ascending order of the numeric key) and `folder`/ranks. Rows of one
    key are ordered by their ids; a null key comes first; an empty table writes empty tables. Other columns aren't read,
    and the key's name isn't written."""
    spark = df.sparkSession
    tables = Tables(spark, "ids")
    made = tables.written(encoded(df, path, end_id, key, text), "ids", codec="zstd")
    ids, width = made.where("ids IS NOT NULL").select("k", "ids"), width_of(path, end_id)
    ranked_ids(made.where("ids IS NULL").select("counts")).write.parquet(f"{folder}/ranks")
    table = spark.read.parquet(f"{folder}/ranks").select("id", "rank").toPandas()  # the vocabulary at most
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 0, np.uint32)
    rank_of[table["id"]] = table["rank"]
    shared = spark.sparkContext.broadcast(rank_of)
    fields = ["part", "block", "start", "keys", "lengths", "control", "data"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's ranks as bytes, so that no more than these is shuffled."""
        for batch in batches:
            column = batch.column(1)
            for a, b in chunks(column, 1 << 22):
                part = column.slice(a, b - a).to_pylist()
                counts = np.fromiter(map(len, part), np.int64, len(part)) // np.dtype(width).itemsize
                control, n_control, data, n_data = varbytes.encode_rows(shared.value[np.frombuffer(b"".join(part), width)], counts)
                arrays = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int32()), binaries(control, n_control).cast(pa.binary()), binaries(data, n_data).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = None, 0, 0
        keys, lengths, controls, parts = [], [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([lengths], pa.list_(pa.int32())), pa.array([b"".join(controls)], pa.binary()), pa.array([b"".join(parts)], pa.binary())], fields)

        for batch in batches:
            key_type = batch.column(0).type
            for k, n, control, data, own in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if held and (own != part or held + n > BLOCK_IDS):
                    yield flush()
                    block, start, held = (block + 1, start + held, 0) if own == part else (0, 0, 0)
                    for x in (keys, lengths, controls, parts):
                        x.clear()
                part = own
                keys.append(k)
                lengths.append(n)
                controls.append(control)
                parts.append(data)
                held += n
        if keys:
            yield flush()

    kind = df.schema[key].dataType.simpleString()
    schema = f"part int, block bigint, start bigint, keys array<{kind}>, lengths array<int>, control binary, data binary"
    rows = ids.mapInArrow(coded, f"k {kind}, n int, control binary, data binary")
    # cut points of the keys alone, so that nothing is coded twice to find ranges
    rows = rows.withColumn("part", part_of(F.col("k"), cut_points(ids, "k", PART_ROWS)).cast("int"))
    rows = rows.repartition("part").sortWithinPartitions("part", "k", "n", "data", "control")
    rows.mapInArrow(blocks, schema).write.option("compression", "uncompressed").parquet(f"{folder}/ids")
    tables.drop(made)


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of each document in the files: how many ids stand before it, and its ids as little-endian
    unsigned 32-bit integers. `key` names the first column; where it is start or ids, the other so called gets an
    underscore."""
    at, of = beside(key, "start", "ids")
    on_workers(spark)
    table = spark.read.parquet(f"{folder}/ranks").select("id", "rank").toPandas().sort_values("rank")
    shared = spark.sparkContext.broadcast(table["id"].to_numpy(np.uint32))
    found = spark.read.parquet(f"{folder}/ids")
    sizes = found.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    # one row a part, and there are 65,536 parts at most
    rows = found.join(F.broadcast(before), "part").select((F.col("before") + F.col("start")).alias("start"), "keys", "lengths", "control", "data")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                start, keys, lengths, control, data = (batch.column(c)[i] for c in range(5))
                n = lengths.values.to_numpy().astype(np.int64)
                ids = shared.value[varbytes.decode_rows(control.as_py(), data.as_py(), n)]
                starts = start.as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(starts, pa.int64()), binaries(ids.astype("<u4", copy=False), n).cast(pa.binary())], [key, at, of])

    kind = found.schema["keys"].dataType.elementType.simpleString()
    return rows.mapInArrow(documents, f"`{key}` {kind}, `{at}` bigint, `{of}` binary")
