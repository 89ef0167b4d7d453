"""Runs, rolling robust statistics and merges along an axis (chrom, idx). A window holds one chromosome's axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(rows: DataFrame, value: str = "value", order: str = "idx", keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(*keys, start, end, value, n): maximal runs of consecutive indices with one value; end is exclusive."""
    island = F.col(order) - F.row_number().over(W.partitionBy(*keys, value).orderBy(order))
    rows = rows.withColumn("__island", island)
    out = rows.groupBy(*keys, value, "__island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "start", "end", F.col(value).alias("value"), "n")


def middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def hampel(rows: DataFrame, value: Column, half: int = 10, sigmas: float = 3.0, order: str = "idx", keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """The rows with x (the value), med, mad and kept: x strictly within sigmas * 1.4826 * MAD of the median of the rows
    from `half` before to half - 1 after. A MAD of 0 keeps none."""
    frame = W.partitionBy(*keys).orderBy(order).rowsBetween(-half, half - 1)
    rows = rows.withColumn("x", value.cast("double")).withColumn("__near", F.sort_array(F.collect_list("x").over(frame)))
    rows = rows.withColumn("med", middle(F.col("__near")))
    rows = rows.withColumn("mad", middle(F.sort_array(F.transform("__near", lambda v: F.abs(v - F.col("med"))))))
    return rows.withColumn("kept", F.abs(F.col("x") - F.col("med")) < sigmas * 1.4826 * F.col("mad")).drop("__near")


def merged(segments: DataFrame, value: str = "value", keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Neighbouring segments (start, end) of one value become one, gaps between them included."""
    order = W.partitionBy(*keys).orderBy("start")
    rows = segments.withColumn("__new", F.when(F.lag(value).over(order).eqNullSafe(F.col(value)), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(order))
    return rows.groupBy(*keys, "__run", value).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("__run")


def copy_numbers(rows: DataFrame, keys: list[str], value: str = "value", ploidy: float = 2.0, most_zeros: float = 0.8) -> DataFrame:
    """(*keys, median, zeros, cn): cn is the median of nonzero values times the ploidy, halves to even; 0 where more than
    `most_zeros` of the values are 0."""
    out = rows.groupBy(*keys).agg(F.percentile(F.when(F.col(value) != 0, F.col(value)), 0.5).alias("median"), F.avg((F.col(value) == 0).cast("int")).alias("zeros"))
    return out.withColumn("cn", F.when(F.col("zeros") > most_zeros, 0).otherwise(F.coalesce(F.rint(F.col("median") * ploidy), F.lit(0.0))).cast("long"))


def near_ends(a: DataFrame, b: DataFrame, tolerance: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Ends of a that have an end of b within the `tolerance` - 1 before or after them."""
    other = b.select(*keys, F.explode(F.sequence(F.col("end") - (tolerance - 1), F.col("end") + (tolerance - 1))).alias("end")).distinct()
    return a.select(*keys, "end").distinct().join(other, [*keys, "end"], "left_semi")


def log2_levels(rows: DataFrame, value: str = "value", least: float = 0.1) -> DataFrame:
    """Values above `least` with their log2."""
    return rows.where(F.col(value) > least).withColumn("log2", F.log2(value))


def absorb_and_merge(segments: DataFrame, most_bins: int = 5, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Segments (start, end, cn): those of cn 0 and fewer than `most_bins`, not last on the axis, take the cn before them
    (after, for the first); then neighbours of one cn merge."""
    order = W.partitionBy(*keys).orderBy("start")
    small = (F.col("cn") == 0) & (F.col("end") - F.col("start") < most_bins) & F.lead("start").over(order).isNotNull()
    rows = segments.withColumn("__keep", F.when(~small, F.col("cn")))
    before = F.last("__keep", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("__keep", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumn("cn", F.coalesce("__keep", before, after)).drop("__keep")
    return merged(rows, "cn", keys)


def without_rare(segments: DataFrame, least: int = 5, cn: str = "cn") -> DataFrame:
    """Segments (start, end, cn): while a copy number has fewer than `least` bins in all, the rarest (the largest in a tie)
    takes the nearest other number (the smaller in a tie). Only the distinct numbers and their counts meet in one
    place."""
    counts = {r[cn]: r["n"] for r in segments.groupBy(cn).agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    into = {k: k for k in counts}
    while len(counts) > 1 and min(counts.values()) < least:
        rare = max(counts, key=lambda k: (-counts[k], k))
        near = min((k for k in counts if k != rare), key=lambda k: (abs(k - rare), k))
        counts[near] += counts.pop(rare)
        into = {k: near if v == rare else v for k, v in into.items()}
    moved = {k: v for k, v in into.items() if k != v}
    if not moved:
        return segments
    pairs = F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])
    return segments.withColumn(cn, F.coalesce(pairs[F.col(cn)], F.col(cn)).cast(segments.schema[cn].dataType))
