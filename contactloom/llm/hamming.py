"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments; an index lists codes by (segment, value). In round r every query looks up the values at
distance r from its own in each of its m segments. Once radii up to r are searched in all segments, every code within
m * (r + 1) - 1 bits has been met, as one further off in each segment would be further off by m * (r + 1). A query ends
when that radius covers its k-th verified distance; others grow on. What is met counts only within the k-th distance
that the query has so far, so lists of far codes end in the join.

Rows of one code are one entry. A code needs no more than its k + 1 smallest ids, taken before they are shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.llm.common import Tables

BITS = 64


def sign_code(vector: Column) -> Column:
    """64 bits, one for each component above 0 (NaN and null are not); null for null, an error beyond 64 components."""
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    code = F.aggregate(F.transform(vector, bit), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit("more than 64 components")).cast("bigint")).otherwise(code)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segments(code: Column, segment_bits: int) -> Column:
    """array<struct<segment, value>>."""
    mask = F.lit((1 << segment_bits) - 1).cast("bigint")
    return F.array(*[F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(code, i * segment_bits).bitwiseAND(mask).alias("value")) for i in range(BITS // segment_bits)])


def flips(segment_bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(segment_bits), radius)]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, segment_bits: int = 16) -> DataFrame:
    """(query, rank 1..k, id, distance) by (distance, id), of rows (id, code) for queries (id, code); a row isn't its own
    answer. Null codes neither ask nor answer; fewer than k rows give fewer ranks; ids that repeat with one code count
    once. Empty tables give an empty table."""
    if BITS % segment_bits or segment_bits > 32:
        raise ValueError("segment_bits must divide 64 and be at most 32")
    need, m = k + 1, BITS // segment_bits
    written = Tables(rows.sparkSession, "top-k").written
    rows = rows.where(F.col("code").isNotNull() & F.col("id").isNotNull()).select("id", "code").distinct()
    queries = queries.where(F.col("code").isNotNull() & F.col("id").isNotNull()).select("id", "code").distinct()
    least = rows.withColumn("at", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("at") <= need)
    least = written(least.select("code", "id"), "codes")
    codes = least.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    codes = written(codes, "codes")
    index = written(codes.select("code", "n", "first", F.inline(segments(F.col("code"), segment_bits))), "index")

    best = W.partitionBy("q").orderBy("distance", "first", "code")
    active = written(queries.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), "queries")
    found = done = None
    for radius in range(segment_bits + 1):
        probes = active.select("q", "bound", F.inline(segments(F.col("q"), segment_bits)))
        probes = probes.withColumn("flip", F.explode(F.lit(flips(segment_bits, radius)).cast("array<bigint>")))
        probes = probes.select("q", "bound", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        # probes grow with the queries and by the flips, which no estimate of their size knows: never to be broadcast
        met = probes.hint("merge").join(index, ["segment", "value"]).where(distance(F.col("q"), F.col("code")) <= F.col("bound"))
        met = met.select("q", "code", "n", "first", distance(F.col("q"), F.col("code")).alias("distance"))
        if found is not None:
            met = met.unionByName(found)
        met = met.distinct().withColumn("at", F.row_number().over(best)).where(F.col("at") <= need)
        met = met.withColumn("sum", F.sum("n").over(best.rowsBetween(W.unboundedPreceding, 0)))
        # without (need) rows so far, nothing is bounded
        met = met.withColumn("bound", F.coalesce(F.min(F.when(F.col("sum") >= need, F.col("distance"))).over(W.partitionBy("q")), F.lit(BITS)))
        met = written(met.select("q", "code", "n", "first", "distance", "bound"), "found")
        covered = F.lit(BITS if radius == segment_bits else m * (radius + 1) - 1)
        state = active.select("q").join(met.groupBy("q").agg(F.first("bound").alias("bound")), "q", "left")
        state = written(state.select("q", F.coalesce("bound", F.lit(BITS)).alias("bound")), "state")
        over = (F.col("bound") < BITS) & (F.col("bound") <= covered) if radius < segment_bits else F.lit(True)
        ended = met.join(state.where(over).select("q"), "q", "left_semi").drop("bound")
        done = ended if done is None else done.unionByName(ended)
        active = state.where(~over)
        if active.isEmpty():
            break
        found = met.join(active.select("q"), "q", "left_semi").drop("bound")

    answers = done.select("q", "code", "distance").join(least, "code")
    answers = queries.select(F.col("id").alias("query"), F.col("code").alias("q")).join(answers, "q").where("id != query")
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "distance")
