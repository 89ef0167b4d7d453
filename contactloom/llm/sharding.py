"""Sharding by weighted rendezvous hashing of a stable record key.

Each shard has a score for a key, -ln(u) / weight with u from a hash of key and shard; the smallest wins. A shard
that is added can only win rows for itself: no row moves between the shards that stay. Slots number the rows of a
shard without gaps: rows are dealt into chunks by a hash, counted by (shard, chunk), and a row's slot is the count
of the chunks before it plus its number in its chunk. So no task holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.llm.common import fresh, spread


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key. 52 bits of md5, so that any engine can compute the same."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0")
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def score(i: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{i}"))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))).alias("s"), F.lit(i).alias("i"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["i"].cast("int")


def shards(df: DataFrame, key: str, weights: Sequence[float], more: Sequence[float] = (1.0,), content: str | None = None, chunk_rows: int = 2000) -> DataFrame:
    """The rows with shard int, slot long (0 .. rows of the shard - 1) and grown_shard int (the shard once shards of
    the weights `more` are added). Columns of these names are replaced; others keep their names and values, whatever these are.

    A null key is a key of its own. Rows of one key share a shard; they are ordered by `content` (a column name),
    and rows alike in both are interchangeable. An empty table gives an empty table."""
    chunk, n, before, number = fresh(df, "chunk", "n", "before", "number")
    parts = spread(df.count(), chunk_rows, 8)
    tied = F.col(content) if content else F.lit(0)
    df = df.withColumn("shard", rendezvous(F.col(key), weights))
    df = df.withColumn(chunk, F.pmod(F.xxhash64(F.col(key), tied), F.lit(parts)))
    counts = df.groupBy("shard", chunk).agg(F.count(F.lit(1)).alias(n))
    sums = counts.select("shard", chunk, (F.sum(n).over(W.partitionBy("shard").orderBy(chunk)) - F.col(n)).alias(before))
    at = F.row_number().over(W.partitionBy("shard", chunk).orderBy(F.col(key), tied))
    out = df.withColumn("grown_shard", rendezvous(F.col(key), [*weights, *more])).withColumn(number, at)
    return out.join(sums, ["shard", chunk]).withColumn("slot", F.col(before) + F.col(number) - 1).drop(chunk, before, number)
