"""Byte-level BPE over a corpus, by one global shuffle of distinct words.

1. Documents are read in blocks. A block's pre-tokens are exploded to positions: it keeps the sequence of word numbers
   (its positions) and sends each of its distinct words once, packed by a hash bucket.
2. Packed words meet by bucket, so that each distinct word of the corpus is encoded in one task, once. The ids go
   back to the blocks that sent the word.
3. Blocks take in their words' ids in bucket order and put documents together by position.

Rows are packed because a row for each pre-token would move several times the size of the texts. Decoding joins ids
with the table of token bytes, which has as many rows as the vocabulary.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm import varbytes
from contactloom.llm.common import Tables, beside, on_workers, released, spread
from contactloom.llm.pretokens import Numbers, pretokens, ranges
from contactloom.llm.token_ids import binaries, chunks

#: Characters of a block; its task holds the words of one, and a longer text is a block.
BLOCK_CHARS = 1 << 25
#: Bytes of text for each bucket of words, so that buckets and the tasks that put blocks together grow with the corpus.
BUCKET_BYTES = 1 << 24


@cache
def merges(path: str):
    """The encoder of single words, by the ranks file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in a row, and by id where a token's start and how many there are."""
    enc = merges(path)
    tokens = [b""] * enc.n_vocab
    for token in enc.token_byte_values():
        tokens[enc.encode_single_token(token)] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def squeeze(values: np.ndarray) -> bytes:
    """Integers packed: their number, then variable-length bytes in planes (control bytes, first bytes, second bytes of
    those that have one, and so on), each by a general compressor at its fastest."""
    values = np.ascontiguousarray(values, "<u4")
    planes = [varbytes.encode(values)[0]]
    each = values.view(np.uint8).reshape(-1, 4)
    planes += [each[values >= (1 << 8 * k) if k else slice(None), k].tobytes() for k in range(4)]
    packed = [zstandard.ZstdCompressor(level=1).compress(p) for p in planes]
    return np.array([len(values), *map(len, packed)], "<u8").tobytes() + b"".join(packed)


def unsqueeze(packed: bytes) -> np.ndarray:
    count, *sizes = np.frombuffer(packed[:48], "<u8").tolist()
    ends = np.cumsum([48, *sizes]).tolist()
    control, *planes = (zstandard.ZstdDecompressor().decompress(packed[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))
    lengths = varbytes.LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    out = np.frombuffer(planes[0], np.uint8).astype(np.uint32)
    for k in range(1, 4):
        if planes[k]:
            out[lengths > k] |= np.frombuffer(planes[k], np.uint8).astype(np.uint32) << (8 * k)
    return out


FIELDS = "block bigint, bucket int, keys array<{key}>, counts array<int>, lengths binary, body binary"
NAMES = ["block", "bucket", "keys", "counts", "lengths", "body"]


def row(key: pa.DataType, block: int, bucket: int, keys: list | None, counts: list | None, lengths: bytes, body: bytes) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.list_(key), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, bucket, keys, counts, lengths, body), kinds, strict=True)], NAMES)


def exploded(df: DataFrame, key: str, text: str, buckets: int, block_chars: int) -> DataFrame:
    """A row of bucket -1 for each block (keys, pre-tokens of each document, word numbers by position, word numbers in
    the order of the rows that follow), and one for each bucket that has words of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key_type = TaskContext.get().partitionId() << 32, None
        numbers, keys, counts, positions = Numbers(), [], [], []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            at = np.concatenate(positions) if positions else np.zeros(0, np.uint32)
            counted = np.argsort(-np.bincount(at, minlength=len(numbers)), kind="stable")
            number_of = np.empty(len(numbers), np.uint32)
            number_of[counted] = np.arange(len(numbers))  # frequent words get small numbers
            given = list(numbers)
            words = [given[i].encode() for i in counted.tolist()]
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            yield row(key_type, block, -1, keys, counts, squeeze(number_of[at]), squeeze(order))
            bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = [words[i] for i in order[a:b].tolist()]
                yield row(key_type, block, int(bucket[order[a]]), None, None, squeeze(np.fromiter(map(len, own), np.uint32, len(own))), zstandard.ZstdCompressor(level=1).compress(b"".join(own)))

        for batch in batches:
            key_type = batch.column(0).type
            texts = batch.column(1)
            for a, b in chunks(texts, 1 << 20):
                for k, t in zip(batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    found = pretokens(t or "")
                    keys.append(k)
                    counts.append(len(found))
                    positions.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                    held += len(t or "")
                    if held >= block_chars:
                        yield from flush()
                        numbers, keys, counts, positions, held, block = Numbers(), [], [], [], 0, block + 1
        if keys:
            yield from flush()
        del numbers, keys, counts, positions
        released()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, FIELDS.format(key=kind))


def word_ids(words: DataFrame, path: str, parts: int) -> DataFrame:
    """For each row of packed words the row of their ids: how many each word has, and all in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        one = merges(path)._core_bpe.encode_single_piece
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for block, bucket, lengths, body in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "lengths", "body")), strict=True):
                ends = np.cumsum(unsqueeze(lengths)).tolist()
                raw = zstandard.ZstdDecompressor().decompress(body) if ends[-1] else b""
                out, start = [], 0
                for end in ends:
                    word = raw[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = one(word)
                    out.append(ids)
                    start = end
                n = np.fromiter(map(len, out), np.uint32, len(out))
                yield row(key_type, block, bucket, None, None, squeeze(n), squeeze(np.fromiter((i for ids in out for i in ids), np.uint32, int(n.sum()))))
        del known
        released()

    return words.repartition(parts, "bucket").mapInArrow(run, words.schema)


def assembled(rows: DataFrame, key: str, path: str, decode: bool, parts: int) -> DataFrame:
    """(key, ids), with `decode` also their bytes, from a block's rows in bucket order, the one of bucket -1 first."""
    kind = rows.schema["keys"].dataType.elementType.simpleString()
    added = beside(key, "ids", *["decoded"] * decode)
    names = [key, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, lengths, ids, key_type = None, [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts, at, order = head
            n_of, start_of = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            n = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
            n_of[order], start_of[order] = n, np.cumsum(n) - n
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            docs = np.cumsum(counts)
            for a in range(0, len(keys), 512):
                b = min(len(keys), a + 512)
                own = at[docs[a] - counts[a] : docs[b - 1]]
                took = n_of[own]
                ends = np.concatenate([[0], np.cumsum(took)])
                marks = np.concatenate([[0], np.cumsum(counts[a:b])])
                out, n_ids = flat[ranges(start_of[own], took)].astype("<u4", copy=False), np.diff(ends[marks])
                more = [binaries(*bytes_of(out, n_ids, path)).cast(pa.binary())] if decode else []
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], key_type), binaries(out, n_ids).cast(pa.binary()), *more], names)

        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for bucket, keys, counts, n, body in zip(*(batch.column(c) for c in ("bucket", "keys", "counts", "lengths", "body")), strict=True):
                if bucket.as_py() < 0:
                    if head is not None:
                        yield from flush()
                    head, lengths, ids = (keys.as_py(), counts.values.to_numpy().astype(np.int64), unsqueeze(n.as_py()), unsqueeze(body.as_py())), [], []
                else:
                    lengths.append(unsqueeze(n.as_py()))
                    ids.append(unsqueeze(body.as_py()))
        if head is not None:
            yield from flush()
        del head, lengths, ids
        released()

    return rows.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, f"`{key}` {kind}" + "".join(f", `{c}` binary" for c in added))


def bytes_of(ids: np.ndarray, counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids joined with the token-byte table: the bytes of all texts in a row, and how many each text has."""
    flat, starts, lengths = token_bytes(path)
    n = lengths[ids]
    ends, marks = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(counts)])
    return flat[ranges(starts[ids], n)], np.diff(ends[marks])


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, decode: bool = False) -> DataFrame:
    """(key, ids): the ids of each row's text as little-endian unsigned 32-bit integers, by the ranks at `path`; with
    `decode` also `decoded`, the bytes that `decoded()` gives for them, in the same task. Null and empty texts have none. Repeated rows and keys, and null keys, give a row each; an empty table an empty one. Where the key is called ids or decoded, the column so called gets
    an underscore."""
    spark = df.sparkSession
    on_workers(spark)
    parts = spread(df.agg(F.sum(F.octet_length(text))).first()[0] or 0, BUCKET_BYTES, 1, 1 << 14)
    rows = Tables(spark, "bpe").written(exploded(df, key, text, parts, block_chars), "words")
    ids = word_ids(rows.where("bucket >= 0"), path, parts)
    return assembled(rows.where("bucket < 0").union(ids), key, path, decode, parts)


def decoded(ids: Column, path: str) -> Column:
    """The bytes of ids (little-endian unsigned 32-bit integers), by the token-byte table."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for a, b in chunks(batch, 1 << 20):
                part = [p or b"" for p in batch.slice(a, b - a).to_pylist()]
                counts = np.fromiter(map(len, part), np.int64, len(part)) // 4
                out.append(binaries(*bytes_of(np.frombuffer(b"".join(part), "<u4"), counts, path)).cast(pa.binary()))
            yield pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return run(ids)
