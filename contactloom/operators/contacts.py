"""Statistics of sparse symmetric contact maps: pixels (bin1_id <= bin2_id, count) and bins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.functions import kernels


def is_valid(weight: Column) -> Column:
    """Whether a bin counts: it has a finite weight above 0."""
    return weight.isNotNull() & ~F.isnan(weight) & (weight > 0) & (weight != float("inf"))


def excluding(bins: DataFrame, names: tuple[str, ...] = ("M", "Y", "MT", "EBV"), chrom: str = "chrom") -> DataFrame:
    """Without chromosomes of these names (any prefix of the letters c, h, r aside) and unplaced ones (with _)."""
    return bins.where(~F.ltrim(F.col(chrom), F.lit("chr")).isin(*names) & ~F.contains(F.col(chrom), F.lit("_")))


def without_substrings(bins: DataFrame, parts: tuple[str, ...] = ("_", "M", "X", "Y", "MT", "EBV"), chrom: str = "chrom") -> DataFrame:
    """Chromosomes whose name holds none of the parts."""
    return bins.where(reduce(lambda a, b: a & b, (~F.contains(F.col(chrom), F.lit(p)) for p in parts)))


def paired(pixels: DataFrame, bins: DataFrame, *columns: str) -> DataFrame:
    """Pixels with the columns of both bins, as <column>1 and <column>2. Bins are left to the optimizer to broadcast."""
    for side in ("1", "2"):
        own = bins.select(F.col("bin_id").alias(f"bin{side}_id"), *[F.col(c).alias(f"{c}{side}") for c in columns])
        pixels = pixels.join(own, f"bin{side}_id")
    return pixels


def balanced(pixels: DataFrame, bins: DataFrame, weight: str = "weight") -> DataFrame:
    """(bin1_id, bin2_id, count, balanced): count times both weights; null where a bin is masked."""
    return paired(pixels, bins, weight).select("bin1_id", "bin2_id", "count", (F.col("count") * F.col(f"{weight}1") * F.col(f"{weight}2")).alias("balanced"))


def fetch(pixels: DataFrame, bins: DataFrame, region1: tuple[str, int, int], region2: tuple[str, int, int] | None = None) -> DataFrame:
    """Pixels of a block of two regions (chrom, start, end), with the first region's bins first; both triangles."""
    def of(region: tuple[str, int, int], side: str) -> DataFrame:
        chrom, start, end = region
        return bins.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start)).select(F.col("bin_id").alias(side))

    both = pixels.select("bin1_id", "bin2_id", "count").union(pixels.where("bin1_id != bin2_id").select("bin2_id", "bin1_id", "count"))
    return both.join(of(region1, "bin1_id"), "bin1_id").join(of(region2 or region1, "bin2_id"), "bin2_id").select("bin1_id", "bin2_id", "count")


def marginals(pixels: DataFrame, ignore: int = 0) -> DataFrame:
    """(bin_id, coverage, nnz): row and column sums, the diagonal in both; diagonals below `ignore` left out. Pixels are
    summed before the two sides meet, so that a shuffle carries one row a bin and task."""
    kept = pixels.where((F.abs(F.col("bin2_id") - F.col("bin1_id")) >= ignore) & (F.col("count") != 0))
    ends = kept.select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), "count")
    return ends.groupBy("bin_id").agg(F.sum("count").alias("coverage"), F.count(F.lit(1)).alias("nnz"))


def mad_filter(coverage: DataFrame, bins: DataFrame, most: float = 5.0) -> DataFrame:
    """(bin_id, scaled, kept): coverage over its chromosome's median of nonzero bins; kept above
    exp(median - most * MAD) of its logs."""
    rows = coverage.where("coverage > 0").join(bins.select("bin_id", "chrom"), "bin_id")
    medians = rows.groupBy("chrom").agg(F.percentile("coverage", 0.5).alias("m"))
    rows = rows.join(medians, "chrom").select("bin_id", (F.col("coverage") / F.col("m")).alias("scaled"))
    center = rows.agg(F.percentile(F.log("scaled"), 0.5).alias("center"))
    spread = rows.crossJoin(F.broadcast(center)).agg(F.percentile(F.abs(F.log("scaled") - F.col("center")), 0.5).alias("mad"))  # one row
    limits = center.crossJoin(spread)
    return rows.crossJoin(F.broadcast(limits)).select("bin_id", "scaled", (F.col("scaled") >= F.exp(F.col("center") - most * F.col("mad"))).alias("kept"))


def usable_bins(pixels: DataFrame, bins: DataFrame, min_nnz: int = 10, min_count: int = 0, mad_max: float = 5.0, ignore: int = 1) -> DataFrame:
    """Bins with at least `min_nnz` contacts off the first `ignore` diagonals, a coverage of at least `min_count`, and a
    coverage that isn't far below their chromosome's."""
    cover = marginals(pixels, ignore)
    kept = mad_filter(cover, bins, mad_max).where("kept").join(cover.where((F.col("nnz") >= min_nnz) & (F.col("coverage") >= min_count)), "bin_id")
    return bins.join(kept.select("bin_id"), "bin_id", "left_semi")


def mean_marginal(pixels: DataFrame) -> DataFrame:
    """One row, `scale`: the mean coverage of bins that have any."""
    return marginals(pixels).where("coverage > 0").agg(F.avg("coverage").alias("scale"))


def bias(bins: DataFrame, weight: str = "weight") -> DataFrame:
    """Bins with `bias`, one over the weight; 0 for bins that don't count."""
    return bins.withColumn("bias", F.when(is_valid(F.col(weight)), 1 / F.col(weight)).otherwise(0.0))


#: Base pairs of the genome that depths refer to, and the share of contacts within chromosomes (fixed values).
GENOME, WITHIN = 3_031_042_417, 0.73256754


def model_choice(pixels: DataFrame, bins: DataFrame, size: int, models: dict[int, list[int]]) -> DataFrame:
    """(size, depth, chosen): the nearest of the models' bin sizes, the depth that the map has for it, and the nearest of
    its depths."""
    at = min(models, key=lambda m: abs(m - size))
    genome = bins.groupBy("chrom").agg(F.max("end").alias("n")).agg(F.sum("n").alias("genome"))
    rows = depth(pixels).crossJoin(genome)  # one row each
    rows = rows.withColumn("depth", F.lit(float(GENOME)) / F.col("genome") * F.col("depth") * (size / at) * F.lit(WITHIN))
    return rows.select(F.lit(at).alias("size"), "depth", nearest_value(models[at], F.col("depth")).alias("chosen"))


def valid_pairs(bins: DataFrame, longest: int | None = None, by: tuple[str, ...] = ("chrom",), weight: str = "weight", value: str | None = None) -> DataFrame:
    """(*by, distance, pairs): how many pairs of valid bins there are at each distance in bins; with `value` also by the
    values of both, as <value>1 <= <value>2. Counts are correlations of the masks of a chromosome's bins, so that no pair
    is made; a task holds one chromosome's masks."""
    columns = [*by, "bin_id", *[value] * (value is not None)]
    rows = bins.where(is_valid(F.col(weight))).select(*columns)
    names = [*by, *[f"{value}1", f"{value}2"] * (value is not None), "distance", "pairs"]
    kind = lambda c: bins.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"`{c}` {kind(c)}" for c in by], *[f"`{value}{i}` {kind(value)}" for i in "12" if value is not None], "distance bigint, pairs bigint"])

    def count(part: pd.DataFrame) -> pd.DataFrame:
        at = (part["bin_id"] - part["bin_id"].min()).to_numpy()
        groups = [None] if value is None else sorted(part[value].dropna().unique())
        masks = []
        for g in groups:
            mask = np.zeros(at.max() + 1)
            mask[at if g is None else at[(part[value] == g).to_numpy()]] = 1
            masks.append(mask)
        out = []
        for x, a in enumerate(masks):
            for y, b in enumerate(masks[x:], x):
                n = kernels.pair_counts(a, b) + (kernels.pair_counts(b, a) if x != y else 0)
                d = np.flatnonzero(n)
                d = d if longest is None else d[d <= longest]
                own = {c: part[c].iloc[0] for c in by} | ({} if value is None else {f"{value}1": groups[x], f"{value}2": groups[y]})
                out.append(pd.DataFrame({**{c: [v] * len(d) for c, v in own.items()}, "distance": d, "pairs": n[d]}))
        return pd.concat(out)[names] if out else pd.DataFrame({c: [] for c in names})

    return rows.groupBy(*by).applyInPandas(count, schema)


def expected(pixels: DataFrame, bins: DataFrame, longest: int | None = None, weight: str = "weight", least_pairs: int = 10) -> DataFrame:
    """(distance, total, pairs, value): mean balanced contact at each distance within chromosomes, over all pairs of
    valid bins, also those without a pixel. Distances need more than `least_pairs` pairs and a sum above 0."""
    rows = paired(pixels, bins, "chrom", weight).where((F.col("chrom1") == F.col("chrom2")) & is_valid(F.col(f"{weight}1")) & is_valid(F.col(f"{weight}2")))
    rows = rows.withColumn("distance", F.col("bin2_id") - F.col("bin1_id"))
    if longest is not None:
        rows = rows.where(F.col("distance") <= longest)
    total = rows.groupBy("distance").agg(F.sum(F.col("count") * F.col(f"{weight}1") * F.col(f"{weight}2")).alias("total"))
    pairs = valid_pairs(bins, longest, weight=weight).groupBy("distance").agg(F.sum("pairs").alias("pairs"))
    return total.join(pairs, "distance").where((F.col("pairs") > least_pairs) & (F.col("total") > 0)).withColumn("value", F.col("total") / F.col("pairs"))


def depth(pixels: DataFrame, most_pixels: int = 10**8, per_pixel: float = 2.14447683) -> DataFrame:
    """(nnz, total, depth): the sum of counts, or an estimate by the number of pixels from `most_pixels` on."""
    return pixels.agg(F.count(F.lit(1)).alias("nnz"), F.sum("count").alias("total")).withColumn("depth", F.when(F.col("nnz") < most_pixels, F.col("total").cast("double")).otherwise(F.col("nnz") * per_pixel))


def nearest_value(values: list[int], to: Column) -> Column:
    """Of the values the nearest to a number, the first in a tie."""
    return F.array_min(F.transform(F.lit(values), lambda v, i: F.struct(F.abs(v - to).alias("d"), i.alias("i"), v.alias("v"))))["v"]


def cn_pairs(pixels: DataFrame, bins: DataFrame, trans: bool, cn: str = "cn", weight: str = "weight", least: int = 3) -> DataFrame:
    """Mean balanced contact by copy numbers (cn1 <= cn2) of the bins, over all pairs of valid bins, with or without a
    pixel. trans: bins of different chromosomes; else by distance within one, with `least` pairs at least. Bins carry
    their copy number, so that segments are never paired with each other."""
    ok = bins.where(is_valid(F.col(weight)))
    rows = paired(pixels, ok, "chrom", weight, cn).where(F.col("chrom1") != F.col("chrom2") if trans else F.col("chrom1") == F.col("chrom2"))
    key = [F.least(f"{cn}1", f"{cn}2").alias("cn1"), F.greatest(f"{cn}1", f"{cn}2").alias("cn2")]
    distance = [] if trans else [(F.col("bin2_id") - F.col("bin1_id")).alias("distance")]
    names = ["cn1", "cn2"] if trans else ["cn1", "cn2", "distance"]
    total = rows.select(*key, *distance, (F.col("count") * F.col(f"{weight}1") * F.col(f"{weight}2")).alias("v")).groupBy(*names).agg(F.sum("v").alias("total"))
    if trans:
        sizes = ok.groupBy("chrom", cn).agg(F.count(F.lit(1)).alias("n"))  # chromosomes times copy numbers
        a, b = (sizes.select(F.col("chrom").alias(f"c{s}"), F.col(cn).alias(f"k{s}"), F.col("n").alias(f"n{s}")) for s in "12")
        pairs = a.join(b, F.col("c1") < F.col("c2")).select(F.least("k1", "k2").alias("cn1"), F.greatest("k1", "k2").alias("cn2"), (F.col("n1") * F.col("n2")).alias("n"))
    else:
        pairs = valid_pairs(bins, weight=weight, value=cn).select(F.col(f"{cn}1").alias("cn1"), F.col(f"{cn}2").alias("cn2"), "distance", F.col("pairs").alias("n"))
    pairs = pairs.groupBy(*names).agg(F.sum("n").alias("n"))
    out = pairs.join(total, names, "left").withColumn("mean", F.coalesce("total", F.lit(0.0)) / F.col("n"))
    return (out if trans else out.where(F.col("n") >= least)).select(*names, "n", "mean")


def distance_normalized(pixels: DataFrame, curve: DataFrame, value: str = "count") -> DataFrame:
    """Values over the curve's at their distance; as they are beyond the curve."""
    known = curve.select("distance", F.col("value").alias("__e"))
    rows = pixels.withColumn("distance", F.abs(F.col("bin2_id") - F.col("bin1_id")))
    return rows.join(known, "distance", "left").withColumn("normalized", F.coalesce(F.try_divide(value, "__e"), F.col(value).cast("double"))).drop("__e")


def minmax(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Values scaled to 0..1 within groups; null where a group is flat."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return rows.join(ends, by).withColumn("scaled", F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def percentile_of_nonzero(pixels: DataFrame, share: float, by: list[str], value: str = "count") -> DataFrame:
    return pixels.where(F.col(value) != 0).groupBy(*by).agg(F.percentile(value, share).alias("level"))


def candidates(pixels: DataFrame, bins: DataFrame, lower: int, upper: int, least_cells: int = 5, weight: str = "weight") -> DataFrame:
    """Pixels within a chromosome whose distance in bins is in [lower, upper], with a value above 0 and a mean above 0 at
    their distance over more than `least_cells` pairs of valid bins."""
    rows = paired(pixels, bins.where(is_valid(F.col(weight))), "chrom", weight).where("chrom1 = chrom2").withColumn("distance", F.col("bin2_id") - F.col("bin1_id"))
    rows = rows.where(F.col("distance").between(lower, upper)).withColumn("value", F.col("count") * F.col(f"{weight}1") * F.col(f"{weight}2"))
    curve = expected(pixels, bins, upper, weight, least_cells).select("distance", F.col("value").alias("mean"))
    return rows.where("value > 0").join(curve, "distance").select("bin1_id", "bin2_id", "distance", "value", "mean")


def rank_levels(bins: DataFrame, value: str = "cn", out: str = "level") -> DataFrame:
    """Levels 0, 1, ... of the distinct values, ascending. Only distinct values are ranked."""
    levels = bins.select(value).where(F.col(value).isNotNull()).distinct().withColumn(out, F.dense_rank().over(W.orderBy(value)) - 1)
    return bins.join(levels, value, "left")
