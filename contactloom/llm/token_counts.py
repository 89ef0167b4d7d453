"""Token counts of whole texts.

Texts go to Python in Arrow batches and only lengths come back. Inside a batch, texts are cut at safe boundaries
and handed to the encoder in calls of about equal bytes, so that neither one long text nor a run of them decides
how much memory a call takes.

A boundary is safe for a SentencePiece model whose normaliser is the identity and whose pieces hold the
white-space mark only at their start: no merge crosses from a character that isn't white space to a space. The
encoder puts a mark before each piece of text, so the space at the cut is dropped. `boundary_is_safe` checks the
model, and a model that fails gets whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import on_workers

MARK = "▁"


@cache
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def boundary_is_safe(path: str) -> bool:
    sp = model(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(MARK in p.lstrip(MARK) or " " in p for p in pieces):
        return False
    # a normaliser that changes, drops or adds characters makes another text of these
    return all("".join(sp.encode(s, out_type=str)) == MARK + s.replace(" ", MARK) for s in ("a  b c", " x", "ﬁ ½", "a "))


def pieces(text: str, size: int) -> list[str]:
    """The text cut at safe spaces, each part but the last of at least `size` characters."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 < cut and text[cut - 1] in (" ", MARK):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 >= len(text):
            break
        out.append(text[at:cut])
        at = cut + 1
    out.append(text[at:])
    return out


def lengths(texts: list[str | None], path: str, call_bytes: int, piece_chars: int) -> list[int]:
    sp, safe, out = model(path), boundary_is_safe(path), [0] * len(texts)
    owners: list[int] = []
    parts: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for owner, ids in zip(owners, sp.encode(parts, num_threads=1), strict=True):
            out[owner] += len(ids)
        owners.clear()
        parts.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        for part in pieces(text, piece_chars) if safe else [text]:
            owners.append(i)
            parts.append(part)
            held += 2 * len(part)
            if held >= call_bytes:
                flush()
    if parts:
        flush()
    return out


def token_count(text: Column, path: str, call_bytes: int = 1 << 18, piece_chars: int = 256) -> Column:
    """Tokens of each text by the SentencePiece model at `path`, begin and end marks not counted."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(lengths(batch.to_pylist(), path, call_bytes, piece_chars), pa.int64())

    return count(text)


def with_token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The rows with the column `out` (replaced where it is there). Null and empty texts count 0; repeated rows and
    nulls in other columns stay as they are; an empty table gives an empty table. No row moves."""
    on_workers(df.sparkSession)
    return df.withColumn(out, token_count(F.col(text), path))
