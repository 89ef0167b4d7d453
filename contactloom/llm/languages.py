"""The language of whole texts, by a conditional random field over their words (see crf.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm import crf
from contactloom.llm.common import fresh, on_workers, released
from contactloom.llm.token_ids import chunks

UNKNOWN = "und"


def fit(docs: DataFrame, per_language: int = 300, most_bytes: int = 1 << 16, key: str = "doc_id", text: str = "text", language: str = "lang") -> crf.Field | None:
    """A field of texts with a language: of each the `per_language` least by a hash, one in each class of it, so that
    no task holds a language; none over `most_bytes`. All languages are learned, so the driver holds `per_language` texts
    of each; rows that repeat a key in a language give its last text by code point. None where there are no such."""
    some = docs.where(F.col(language).isNotNull() & F.col(key).isNotNull() & (F.octet_length(text) <= most_bytes))
    h = F.xxhash64(F.lit(7), key)
    picks = some.groupBy(F.col(language).alias("y"), F.pmod(h, F.lit(per_language)).alias("r")).agg(F.min(F.struct(h, F.col(key)))[key].alias("k")).select("k", "y")
    rows = some.select(F.col(key).alias("k"), F.col(language).alias("y"), F.col(text).alias("t")).join(F.broadcast(picks), ["k", "y"])  # keys of what the driver holds next
    found = rows.groupBy("k", "y").agg(F.max("t").alias("t")).select("t", "y").toArrow().to_pylist()
    field = crf.fit(sorted((r["t"], r["y"]) for r in found))
    del found
    released()
    return field


def labelled(docs: DataFrame, field: crf.Field | None, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score (replaced where they are there): the language with the largest mean probability
    over the words, the first by name in a tie, and that mean; UNKNOWN and 0 for texts that are null or have no letter,
    and for all without a field. A text is one chain, however long. Nothing moves."""
    on_workers(docs.sparkSession)
    kind = "struct<lang_pred: string, score: double>"
    if field is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = crf.Labeller(field)
        names = np.array([*field.languages, UNKNOWN], object)
        for batch in batches:
            best, score = [], []
            for a, b in chunks(batch, 1 << 22):
                shares, counts = labeller.shares([t or "" for t in batch.slice(a, b - a).to_pylist()])
                best.extend(names[np.where(counts > 0, shares.argmax(axis=1), len(field.languages))])
                score.extend(np.clip(shares.max(axis=1), 0, 1))
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
        del labeller
        released()

    (found,) = fresh(docs, "found")
    out = docs.withColumn(found, run(F.col(text)))
    return out.withColumns({c: F.col(f"{found}.{c}") for c in ("lang_pred", "score")}).drop(found)
