"""Toxicity of whole texts, by the compression distance of their windows (see compression.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm import compression
from contactloom.llm.common import on_workers, released
from contactloom.llm.token_ids import chunks

LEVEL = 0.7


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 2500, most_ordinary: int = 5000, most_bytes: int = 1 << 16, key: str = "doc_id", text: str = "text", label: str = "toxic") -> compression.Model | None:
    """A model of labelled documents: of each label the first by a hash of the key, `most_toxic` and `most_ordinary` at
    most, without texts over `most_bytes`. Keys are chosen from the labels alone and texts fetched for them; a key that
    several rows have gives its last text by code point, and counts as toxic where one of its labels does. None where
    labels are too few to fit."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    order = [F.xxhash64("k"), F.col("k")]
    some = marked.where("y = 1").orderBy(*order).limit(most_toxic).unionByName(marked.where("y = 0").orderBy(*order).limit(most_ordinary))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") <= most_bytes)
    found = rows.join(F.broadcast(some), "k").groupBy("k", "y").agg(F.max("t").alias("t")).select("t", "y").toArrow()  # at most the two limits
    # in order of the text: the same model whatever order rows come in
    toxic, ordinary = (sorted(t for t in found.filter(pc.equal(found["y"], y))["t"].to_pylist() if t) for y in (1, 0))
    del found
    model = compression.fit(toxic, ordinary, LEVEL)
    del toxic, ordinary
    released()
    return model


def score(text: Column, model: compression.Model | None) -> Column:
    """0 to 1, LEVEL at the calibrated threshold; null and empty texts score as texts without windows. 0 without a model."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer()
        for batch in batches:
            out = []
            for a, b in chunks(batch, 1 << 22):
                out.extend(model.scores([t or "" for t in batch.slice(a, b - a).to_pylist()], scorer).tolist())
            yield pa.array(out, pa.float64())
        del scorer
        released()

    return run(text)


def with_scores(docs: DataFrame, model: compression.Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with the column `out` (replaced where it is there); nothing moves, and an empty table stays empty."""
    on_workers(docs.sparkSession)
    return docs.withColumn(out, score(F.col(text), model))
