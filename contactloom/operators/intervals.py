"""Joins and merges of half-open intervals (chrom, start, end).

Overlap joins key both sides by (chrom, bucket): an interval goes to each bucket it touches, and a pair counts in the
first bucket that both touch, so that no distinct is needed. Rows that can't overlap never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucketed(rows: DataFrame, size: int) -> DataFrame:
    first, last = F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)
    return rows.where(F.col("start") < F.col("end")).withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, last)))


def overlap(a: DataFrame, b: DataFrame, size: int = 10_000, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Pairs that overlap: the keys, a's other columns as a_<name>, b's as b_<name>."""
    named = lambda rows, p: rows.select(*keys, "__bucket", *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in (*keys, "__bucket")])
    met = named(bucketed(a, size), "a").join(named(bucketed(b, size), "b").hint("merge"), [*keys, "__bucket"])  # a file's size doesn't tell its buckets': no broadcast
    own = (F.col("__bucket") == F.greatest("a___first", "b___first")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    return met.where(own).drop("__bucket", "a___first", "b___first")


#: Rows at most that one row of equal intervals holds, about.
EQUAL = 1 << 16


def equal_rows(rows: DataFrame, keys: tuple[str, ...] = ("chrom",), key: str = "id") -> DataFrame:
    """(*keys, start, end, part, ids): rows, told apart by `key`, of one interval together, in parts of some `EQUAL`."""
    span = [*keys, "start", "end"]
    most = rows.groupBy(*span).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64(key), F.lit(1 + most // EQUAL)).alias("part")
    return rows.groupBy(*span, part).agg(F.collect_list(key).alias("ids"))


def overlap_of_equals(a: DataFrame, b: DataFrame, size: int = 10_000, keys: tuple[str, ...] = ("chrom",), key: str = "id", more: dict[str, Column] | None = None) -> DataFrame:
    """As overlap, of rows (*keys, start, end, `key`): distinct intervals meet, and what shares them is paired afterwards, so
    that what is shuffled grows with the rows, not with their pairs. `more` are columns of both intervals, worked out before."""
    one = equal_rows(a, keys, key)
    met = overlap(one, one if b is a else equal_rows(b, keys, key), size, keys).drop("a_part", "b_part").withColumns(more or {})
    met = met.withColumn(f"a_{key}", F.explode("a_ids")).drop("a_ids")
    return met.withColumn(f"b_{key}", F.explode("b_ids")).drop("b_ids")


def overlapping(a: DataFrame, b: DataFrame, how: str = "left_semi", size: int = 10_000, keys: tuple[str, ...] = ("chrom",), key: str = "id") -> DataFrame:
    """Rows of a, told apart by `key`, that overlap a row of b ("left_semi"), or none ("left_anti")."""
    hits = overlap(a.select(*keys, "start", "end", key), b.select(*keys, "start", "end"), size, keys).select(F.col(f"a_{key}").alias(key)).distinct()
    return a.join(hits, key, how)


def length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the span of both."""
    return F.try_divide(length(s1, e1, s2, e2), F.greatest(e1, e2) - F.least(s1, s2))


def coalesced(rows: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(*keys, start, end, n): unions of overlapping intervals; those that only touch stay apart. One task sorts a key's
    intervals; identical ones are counted before that."""
    rows = rows.groupBy(*keys, "start", "end").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__island")


def meeting_others(rows: DataFrame, how: str = "left_semi", size: int = 10_000, keys: tuple[str, ...] = ("chrom",), key: str = "id") -> DataFrame:
    """Rows, told apart by `key`, that overlap another row ("left_semi"), or none ("left_anti"). An interval overlaps another
    just where its union holds several, so no pairs are made."""
    several = coalesced(rows.where(F.col("start") < F.col("end")), keys).where("n > 1")
    return overlapping(rows, several, how, size, keys, key)


def range_means(rows: DataFrame, track: DataFrame, key: str = "id", size: int = 10_000) -> DataFrame:
    """(key, signal): the track's mean over the covered part of each row, weighted by length; 0 without cover. Each distinct
    range meets the track once."""
    span = ["chrom", "start", "end"]
    met = overlap(rows.select(*span).distinct(), track.select(*span, "value"), size)
    n = length(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    found = met.groupBy("chrom", F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg((F.sum(F.col("b_value") * n) / F.sum(n)).alias("signal"))
    return rows.select(*span, key).join(found.hint("merge"), span, "left").select(key, F.coalesce("signal", F.lit(0.0)).alias("signal"))


def binned_means(rows: DataFrame, track: DataFrame, parts: int, key: str = "id", size: int = 10_000) -> DataFrame:
    """(key, part, signal): as range_means for each of `parts` equal parts of a row, numbered from 0."""
    step = (F.col("end") - F.col("start")) / parts
    cut = rows.select("chrom", key, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "start", step.alias("step"))
    cut = cut.select("chrom", F.struct(key, "part").alias("at"), F.floor(F.col("start") + F.col("part") * F.col("step")).alias("start"), F.floor(F.col("start") + (F.col("part") + 1) * F.col("step")).alias("end"))
    return range_means(cut, track, "at", size).select(f"at.{key}", "at.part", "signal")


def counted_in_bins(points: DataFrame, bins: DataFrame, size: int, at: str = "pos") -> DataFrame:
    """(bin_id, n): distinct points in each bin, 0 where there are none."""
    n = points.select("chrom", at).distinct().groupBy("chrom", (F.floor(F.col(at) / size) * size).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, ["chrom", "start"], "left").select("bin_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def rebinned(segments: DataFrame, bins: DataFrame, size: int = 10_000) -> DataFrame:
    """(bin_id, value): of each bin the value that covers most of it, the smallest in a tie; what no segment covers has
    value 0. Where both halves of a bin have one mean, that mean."""
    middle = F.col("a_start") + F.floor((F.col("a_end") - F.col("a_start")) / 2)
    met = overlap(bins.select("chrom", "start", "end", "bin_id"), segments.select("chrom", "start", "end", "value"), size)
    n = length(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    left = length(F.col("a_start"), middle, F.col("b_start"), F.col("b_end"))
    parts = met.groupBy(F.col("a_bin_id").alias("bin_id"), F.col("b_value").cast("double").alias("value")).agg(F.sum(n).alias("n"), F.sum(left).alias("left"))
    covered = parts.groupBy("bin_id").agg(F.sum("n").alias("covered"), F.sum(F.col("value") * F.col("left")).alias("a"), F.sum(F.col("value") * (F.col("n") - F.col("left"))).alias("b"))
    wide = F.col("end") - F.col("start")
    half = F.floor(wide / 2)
    whole = bins.join(covered, "bin_id", "left").select("bin_id", wide.alias("wide"), half.alias("half"), (wide - F.coalesce("covered", F.lit(0))).alias("n"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    both = parts.select("bin_id", "value", "n").unionByName(whole.select("bin_id", F.lit(0.0).alias("value"), "n")).groupBy("bin_id", "value").agg(F.sum("n").alias("n")).where("n > 0")
    most = both.groupBy("bin_id").agg(F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("most"))
    even = F.col("a") * (F.col("wide") - F.col("half")) == F.col("b") * F.col("half")
    return whole.join(most, "bin_id").select("bin_id", F.when(even, (F.col("a") + F.col("b")) / F.col("wide")).otherwise(F.col("most")).alias("value"))


def nearest(a: DataFrame, b: DataFrame, tolerance: int, keys: tuple[str, ...] = ("chrom1", "chrom2")) -> DataFrame:
    """For each row of a (id, p1, p2) the nearest row of b in the plane, the smallest id in a tie, if it is within
    min(tolerance, a fifth of |p1 - p2|). Points meet by the cells of a grid as wide as the tolerance."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = F.least(F.lit(float(tolerance)), F.abs(F.col("p1") - F.col("p2")) * 0.2)
    probes = a.select(*keys, "id", "p1", "p2", near.alias("near"), F.explode(F.sequence(cell("p1") - 1, cell("p1") + 1)).alias("g1"))
    probes = probes.withColumn("g2", F.explode(F.sequence(cell("p2") - 1, cell("p2") + 1)))
    other = b.select(*keys, F.col("id").alias("b_id"), F.col("p1").alias("b_p1"), F.col("p2").alias("b_p2"), cell("p1").alias("g1"), cell("p2").alias("g2"))
    square = F.pow(F.col("p1") - F.col("b_p1"), 2) + F.pow(F.col("p2") - F.col("b_p2"), 2)
    met = probes.join(other, [*keys, "g1", "g2"]).select("id", "near", "b_id", F.sqrt(square).alias("distance")).where(F.col("distance") <= F.col("near"))
    return met.groupBy("id").agg(F.min(F.struct("distance", "b_id")).alias("m")).select("id", F.col("m.b_id").alias("match"), "m.distance")
