"""Operators with a numeric kernel: curves, slopes, balancing, segmentation, clusters, domains, structures.

What relates rows is DataFrame work; a kernel sees one group (a chromosome's axis, a pair of blocks, an assembly)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import kernels
from contactloom.operators.contacts import cn_pairs, is_valid, paired
from contactloom.operators.intervals import nearest
from contactloom.operators.written import shuffles, written


def isotonic_curve(curve: DataFrame, longest: int) -> DataFrame:
    """(distance, value) for 0..longest: the decreasing fit of a curve, between points on lines, beyond them flat."""
    def fit(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("distance")
        at = np.arange(longest + 1)
        return pd.DataFrame({"distance": at, "value": np.interp(at, points["distance"], kernels.isotonic_decreasing(points["value"].to_numpy(float)))})

    # one row a distance, so one group is a curve
    return curve.select("distance", "value", F.lit(0).alias("curve")).groupBy("curve").applyInPandas(fit, "distance bigint, value double")


#: Fits that a task keeps.
FITS = 50_000


def slopes(observed: DataFrame, curve: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """(*keys, slope, r2, n, unclear): robust lines of observed means on a curve at common distances, by group: of all
    distances or of those after a flat start, whichever fits better; slope 0 where too few are inliers."""
    return lines_up_to(observed, curve, keys, [None], least).select(*keys, "slope", "r2", "n", "unclear")


def lines_up_to(observed: DataFrame, curve: DataFrame, keys: list[str], ranges: list[int | None], least: int = 5) -> DataFrame:
    """(*keys, upto, slope, r2, n, unclear): as slopes, a row for each range of distances with `least` points. A group is one
    row of its points, as many as there are distances, and tasks take rows in batches; equal points, which meet in one
    task, have one fit."""
    both = observed.join(curve.select("distance", F.col("value").cast("double").alias("expected")), "distance")
    points = F.array_sort(F.collect_list(F.struct(F.col("distance").cast("double").alias("d"), "expected", F.col("mean").cast("double").alias("m"))))
    rows = both.groupBy(*keys).agg(points.alias("points")).select(*keys, F.col("points.d").alias("d"), F.col("points.expected").alias("x"), F.col("points.m").alias("y"))
    rows = rows.repartition(shuffles(observed.sparkSession), F.xxhash64("d", "x", "y"))
    kinds = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "upto", "slope", "r2", "n", "unclear"]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[float, float, bool]] = {}

        def line(d: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float, bool]:
            points = np.concatenate([d, x, y]).tobytes()
            if points not in known:
                if len(known) >= FITS:
                    known.clear()
                known[points] = (*kernels.best_line(d, x, y, least), kernels.trend_is_unclear(d, y))
            return known[points]

        for rows in batches:
            out = []
            for own, d, x, y in zip(rows[keys].itertuples(index=False, name=None), rows["d"], rows["x"], rows["y"], strict=True):
                for n, upto in ((len(d) if u is None else int(np.searchsorted(d, u, side="right")), u) for u in ranges):
                    if n >= least:
                        slope, r2, unclear = line(d[:n], x[:n], y[:n])
                        out.append((*own, upto or 0, slope, r2, n, unclear))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(fit, f"{kinds}, upto int, slope double, r2 double, n bigint, unclear boolean")


def best_slopes(observed: DataFrame, curve: DataFrame, keys: list[str], ranges: list[int], least: int = 5) -> DataFrame:
    """For each group the line of largest R2 over ranges of distance, the first in a tie; unclear where any range's trend is."""
    every = lines_up_to(observed, curve, keys, ranges, least)
    best = every.groupBy(*keys).agg(F.max_by(F.struct("upto", "slope", "r2", "n"), F.struct("r2", -F.col("upto"))).alias("b"), F.max("unclear").alias("unclear"))
    return best.select(*keys, "b.*", "unclear")


def rescaled(contacts: DataFrame, frame: DataFrame, lines: DataFrame, least_r2: float = 0.6, given: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Axis contacts with `scaled`: blocks over their own slope, pairs of blocks times min(1 / slope, 5 / the larger slope of
    the two blocks), where R2 is above the level and the slopes above 0; others as they are. Slopes `given` (*keys, block1,
    block2, slope) go before those found."""
    own = lines.where("block1 = block2").select(*keys, F.col("block1").alias("block"), F.col("slope").alias("own"))
    rows = lines.join(own.toDF(*keys, "block1", "own1"), [*keys, "block1"], "left").join(own.toDF(*keys, "block2", "own2"), [*keys, "block2"], "left")
    top = F.greatest(F.coalesce("own1", F.lit(0.0)), F.coalesce("own2", F.lit(0.0)))
    ok = (F.col("r2") > least_r2) & (F.col("slope") > 0) & (top > 0)
    factor = F.when(F.col("block1") == F.col("block2"), 1 / F.col("slope")).otherwise(F.least(1 / F.col("slope"), 5 / top))
    pair = [*keys, "block1", "block2"]
    factors = rows.select(*pair, F.when(ok, factor).alias("factor"))
    if given is not None:
        named = given.select(*pair, (1 / F.col("slope")).alias("user"))
        factors = factors.join(named, pair, "full").select(*pair, F.coalesce("user", "factor").alias("factor"))
    place = frame.select(*keys, "idx", "block")
    rows = contacts.join(place.toDF(*keys, "i", "block1"), [*keys, "i"]).join(place.toDF(*keys, "j", "block2"), [*keys, "j"])
    return rows.join(factors, pair, "left").select(*keys, "i", "j", "count", (F.col("count") * F.coalesce("factor", F.lit(1.0))).alias("scaled"))


def balanced_by_class(pixels: DataFrame, bins: DataFrame, cn: str = "cn", ignore: int = 1, tolerance: float = 1e-5, rounds: int = 50) -> DataFrame:
    """(bin_id, cn, sweight, variance, converged): weights that even out coverage within each copy-number class. In each round a
    bin's weight is divided by its coverage over the mean of its class; bins without coverage, class or a valid weight are
    null. Rounds end when the variance within classes, weighted by size, is below the tolerance."""
    usable = bins.where(is_valid(F.col("weight")) & (F.col(cn) != 0)).select("bin_id", F.col(cn).alias("cn"))
    pixels = written(pixels.where(F.abs(F.col("bin2_id") - F.col("bin1_id")) >= ignore), "pixels")
    bias = state = written(usable.withColumn("bias", F.lit(1.0)), "bias")
    for _ in range(rounds):
        a, b = (bias.select(F.col("bin_id").alias(f"bin{s}_id"), F.col("bias").alias(f"b{s}")) for s in "12")
        value = F.col("count") * F.col("b1") * F.col("b2")
        ends = pixels.join(a, "bin1_id").join(b, "bin2_id").select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), value.alias("v"))
        marg = bias.join(ends.groupBy("bin_id").agg(F.sum("v").alias("m")), "bin_id", "left").withColumn("m", F.nullif("m", F.lit(0.0)))
        classes = marg.groupBy("cn").agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var"), F.count("m").alias("n"))
        state = written(marg.join(classes, "cn").select("bin_id", "cn", F.when(F.col("mean").isNull(), 0.0).otherwise(F.col("bias") / F.coalesce(F.col("m") / F.col("mean"), F.lit(1.0))).alias("bias"), "mean", "var", "n"), "bias", state)
        variance = state.select("cn", "var", "n").distinct().agg(F.try_divide(F.sum(F.col("var") * F.col("n")), F.sum("n"))).first()[0]
        bias = state.select("bin_id", "cn", "bias")
        if variance is None or variance < tolerance:
            break
    out = state.select("bin_id", F.nullif(F.col("bias") / F.sqrt("mean"), F.lit(0.0)).alias("sweight"), F.lit(variance).cast("double").alias("variance"), F.lit(variance is None or variance < tolerance).alias("converged"))
    return bins.select("bin_id", F.col(cn).alias("cn")).join(out, "bin_id", "left")


def poisson_profile(rows: DataFrame, covariates: list[str], count: str = "coverage") -> DataFrame:
    """(bin_id, ratio): working residuals of a Poisson regression with log link on each covariate, its square and its
    root, less their minimum; 0 for bins without coverage or a covariate."""
    used = rows.where(F.col(count) > 0)
    for c in covariates:
        used = used.where(F.col(c) > 0)
    names = []
    for c in covariates:
        used = used.withColumns({f"{c}_1": F.col(c).cast("double"), f"{c}_2": F.pow(F.col(c), 2), f"{c}_r": F.sqrt(c)})
        names += [f"{c}_1", f"{c}_2", f"{c}_r"]
    used = VectorAssembler(inputCols=names, outputCol="features").transform(written(used.select("bin_id", count, *names), "covariates"))
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol=count, featuresCol="features", maxIter=25, regParam=1e-6).fit(used)
    fitted = model.transform(used).withColumn("residual", (F.col(count) - F.col("prediction")) / F.col("prediction"))
    least = fitted.agg(F.min("residual").alias("least"))
    fitted = fitted.crossJoin(least).select("bin_id", (F.col("residual") - F.col("least")).alias("ratio"))  # one row
    return rows.select("bin_id").join(fitted, "bin_id", "left").select("bin_id", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def mixture_states(rows: DataFrame, value: str, most: int = 10, seed: int = 1) -> DataFrame:
    """(k, aic, chosen): Gaussian mixtures of 1 to `most` parts, no more than there are distinct values, and which has the
    least AIC."""
    spark = rows.sparkSession
    data = VectorAssembler(inputCols=[value], outputCol="features").transform(written(rows.where(F.col(value).isNotNull()).select(value), "values"))
    found = []
    for k in range(1, max(1, data.select(value).distinct().limit(most).count()) + 1):
        fit = GaussianMixture(k=k, seed=seed, maxIter=100).fit(data) if k > 1 else None
        if fit is None:
            n, var = data.agg(F.count(F.lit(1)), F.var_pop(value)).first()
            logs = -0.5 * n * (np.log(2 * np.pi * var) + 1)
        else:
            logs = fit.summary.logLikelihood
        found.append((k, float(2 * (3 * k - 1) - 2 * logs)))
    least = min(found, key=lambda x: x[1])[0]
    return spark.createDataFrame([(k, a, k == least) for k, a in found], "k int, aic double, chosen boolean")


def expecting(means: np.ndarray, variances: np.ndarray, moves: np.ndarray, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def expect(part: pd.DataFrame) -> pd.DataFrame:
        w, s, q, t = kernels.state_sums(part.sort_values("idx")["x"].to_numpy(), means, variances, moves)
        return pd.DataFrame([np.concatenate([w, s, q, t.ravel()])], columns=names)

    return expect


def hidden_states(rows: DataFrame, states: int | None = None, rounds: int = 1000, value: str = "x") -> DataFrame:
    """(chrom, idx, x, state): the likeliest states of a Gaussian hidden Markov model of all chromosomes, numbered by
    rising mean; without `states` as many as the mixture of least AIC has parts. A round sums each chromosome's expected counts in a task and adds them up."""
    rows = written(rows.select("chrom", "idx", F.col(value).cast("double").alias("x")).where("x IS NOT NULL"), "levels")
    if states is None:
        states = 1 if rows.isEmpty() else mixture_states(rows, "x").where("chosen").first()["k"]
    cuts = rows.agg(F.percentile("x", F.lit([(i + 0.5) / states for i in range(states)])), F.var_pop("x")).first()
    if cuts[0] is None:
        return rows.withColumn("state", F.lit(0))
    means, variances = np.array(cuts[0]), np.full(states, max(cuts[1] / states, 1e-6))
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9)
    names = [f"{n}{i}" for n in ("w", "s", "q") for i in range(states)] + [f"t{i}_{j}" for i in range(states) for j in range(states)]
    for _ in range(rounds):
        total = rows.groupBy("chrom").applyInPandas(expecting(means, variances, moves, names), ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        v = np.array([total[n] for n in names])
        w, s, q, t = v[:states], v[states : 2 * states], v[2 * states : 3 * states], v[3 * states :].reshape(states, states)
        means, old = s / np.maximum(w, 1e-9), means
        variances = np.maximum(q / np.maximum(w, 1e-9) - means**2, 1e-4)
        moves = (t + 1e-6) / (t + 1e-6).sum(axis=1, keepdims=True)
        if np.abs(means - old).max() < 1e-3:
            break
    order = np.argsort(means)
    means, variances, moves = means[order], variances[order], moves[np.ix_(order, order)]

    def decode(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        return part.assign(state=kernels.likeliest_states(part["x"].to_numpy(), means, variances, moves))

    return rows.groupBy("chrom").applyInPandas(decode, "chrom string, idx bigint, x double, state int")


def change_points(rows: DataFrame, value: str = "x", shuffles: int = 1000, p: float = 1e-5, inner_p: float = 0.05, seed: int = 7) -> DataFrame:
    """(chrom, start, end, mean): circular binary segmentation of each chromosome, positions in rank order."""
    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        x = part["x"].to_numpy(float)
        found = kernels.segments(x, shuffles, p, inner_p, np.random.default_rng([seed, len(x)]))
        at = part["idx"].to_numpy()
        return pd.DataFrame([(part["chrom"].iloc[0], at[a], at[b - 1] + 1, x[a:b].mean()) for a, b in found], columns=["chrom", "start", "end", "mean"])

    return rows.select("chrom", "idx", F.col(value).cast("double").alias("x")).groupBy("chrom").applyInPandas(cut, "chrom string, start bigint, end bigint, mean double")


def smoothed(window: Column, sigma: float = 1.0) -> Column:
    """A square window, row by row, blurred by a Gaussian (cut at four sigmas, edges mirrored) and scaled to 0..1; null
    where it is flat."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda w: kernels.smoothed_square(np.asarray(w, float), sigma), na_action="ignore")

    return run(window)


def scored(rows: DataFrame, scorer: Column, least: float) -> DataFrame:
    """Windows with prob by any scorer (an expression or a pandas UDF on `window`), at least `least`."""
    return rows.withColumn("prob", scorer).where(F.col("prob") >= least)


def clustered(calls: DataFrame, keys: list[str], radius: float, value: str = "value") -> DataFrame:
    """(*keys, i, j, members): one call a cluster, its seed, for calls (i, j, value) of a block pair."""
    kinds = ", ".join(f"{k} {calls.schema[k].dataType.simpleString()}" for k in keys)

    def group(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        found = kernels.grown_clusters(i, j, part["value"].to_numpy(float), radius)
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), i[s], j[s], len(rows)) for s, rows in found], columns=[*keys, "i", "j", "members"])

    rows = calls.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(value).alias("value"))
    return rows.groupBy(*keys).applyInPandas(group, f"{kinds}, i bigint, j bigint, members bigint")


def matched_once(a: DataFrame, b: DataFrame, tolerance: float, keys: tuple[str, ...] = ("chrom1", "chrom2")) -> DataFrame:
    """(id, match): peaks of a with the peak of b nearest to them, within the tolerance; of those with one match the
    smallest id has it, the others none."""
    met = nearest(a, b, tolerance, keys).groupBy("match").agg(F.min("id").alias("id"))
    return met.select("id", "match")


def directionality(contacts: DataFrame, window: int, keys: tuple[str, ...] = (), frame: DataFrame | None = None) -> DataFrame:
    """(*keys, idx, di): of axis contacts (*keys, i, j, value), sign(B - A) ((A - E)^2 / E + (B - E)^2 / E), with A and B the
    sums to the `window` bins before and after and E their mean. With a frame (*keys, idx) all of its places, 0 where there
    is no contact."""
    near = contacts.where((F.col("j") - F.col("i")).between(1, window))
    ends = near.select(*keys, F.col("i").alias("idx"), F.lit(0.0).alias("a"), F.col("value").cast("double").alias("b"))
    sums = ends.unionByName(near.select(*keys, F.col("j").alias("idx"), F.col("value").cast("double").alias("a"), F.lit(0.0).alias("b"))).groupBy(*keys, "idx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    e = (F.col("a") + F.col("b")) / 2
    out = sums.select(*keys, "idx", F.coalesce(F.signum(F.col("b") - F.col("a")) * F.try_divide(F.pow(F.col("a") - e, 2) + F.pow(F.col("b") - e, 2), e), F.lit(0.0)).alias("di"))
    return out if frame is None else frame.select(*keys, "idx").join(out, [*keys, "idx"], "left").na.fill(0.0, ["di"])


def structures(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, idx, x, y, z) for axis contacts (i, j, value) of each assembly."""
    kinds = ", ".join(f"{k} {contacts.schema[k].dataType.simpleString()}" for k in keys)

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part[(part["i"] != part["j"]) & (part["value"] > 0)].sort_values(["i", "j"])
        at = np.unique(np.concatenate([part["i"], part["j"]]))
        x = kernels.coordinates(np.searchsorted(at, part["i"]), np.searchsorted(at, part["j"]), part["value"].to_numpy(float), len(at)) if len(at) else np.zeros((0, 3))
        return pd.DataFrame({**{k: [part[k].iloc[0]] * len(at) for k in keys}, "idx": at, "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    return contacts.repartition(shuffles(contacts.sparkSession), *keys).groupBy(*keys).applyInPandas(place, f"{kinds}, idx bigint, x double, y double, z double")


def simulated(pixels: DataFrame, bins: DataFrame, reference: int, cn: str = "cn") -> DataFrame:
    """(bin1_id, bin2_id, count, simulated): counts between chromosomes times the factor of their copy numbers, the mean of
    the pair over that of (reference, reference)."""
    means = cn_pairs(pixels, bins, trans=True, cn=cn)
    base = means.where((F.col("cn1") == reference) & (F.col("cn2") == reference)).select(F.col("mean").alias("base"))
    factors = means.crossJoin(base).select("cn1", "cn2", F.try_divide("mean", "base").alias("factor"))  # one row
    rows = paired(pixels, bins, "chrom", cn).where("chrom1 != chrom2").withColumn("k1", F.least(f"{cn}1", f"{cn}2")).withColumn("k2", F.greatest(f"{cn}1", f"{cn}2"))
    return rows.join(factors, (F.col("k1") == factors["cn1"]) & (F.col("k2") == factors["cn2"]), "left").select("bin1_id", "bin2_id", "count", (F.col("count") * F.coalesce("factor", F.lit(0.0))).alias("simulated"))


def simulated_cis(pixels: DataFrame, bins: DataFrame, reference: int, near: int, cn: str = "cn") -> DataFrame:
    """(bin1_id, bin2_id, count, simulated): counts within chromosomes times the factor of their copy numbers: the slope of
    the pair's means by distance on those of (reference, reference), up to `near` bins, or else beyond, where it is above
    0 with an R2 above 0.5; 1 where neither is."""
    means = cn_pairs(pixels, bins, trans=False, cn=cn).withColumn("far", (F.col("distance") > near).cast("int"))
    both = means.unionByName(means.where(F.col("distance") == near).withColumn("far", F.lit(1)))  # the edge is in both bands
    curve = means.where((F.col("cn1") == reference) & (F.col("cn2") == reference)).select("distance", F.col("mean").alias("value"))
    found = slopes(both.where((F.col("cn1") != reference) | (F.col("cn2") != reference)), curve, ["cn1", "cn2", "far"])
    found = found.where("slope > 0 AND r2 > 0.5").groupBy("cn1", "cn2").agg(F.min_by("slope", "far").alias("factor"))
    rows = paired(pixels, bins, "chrom", cn).where("chrom1 = chrom2").withColumn("k1", F.least(f"{cn}1", f"{cn}2")).withColumn("k2", F.greatest(f"{cn}1", f"{cn}2"))
    return rows.join(found.toDF("k1", "k2", "factor"), ["k1", "k2"], "left").select("bin1_id", "bin2_id", "count", (F.col("count") * F.coalesce("factor", F.lit(1.0))).alias("simulated"))


def merged_spans(rows: DataFrame, cuts: DataFrame, least: int = 3, apart: float = 0.4, value: str = "value") -> DataFrame:
    """(chrom, start, end): spans of a track (chrom, idx, value) between cuts (chrom, end), short and alike neighbours put
    together from the left. A task holds one chromosome's axis."""
    both = rows.select("chrom", "idx", F.col(value).cast("double").alias("x"), F.lit(False).alias("cut")).unionByName(cuts.select("chrom", F.col("end").alias("idx"), F.lit(None).cast("double").alias("x"), F.lit(True).alias("cut")))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        track = part[~part["cut"]].sort_values("idx")
        at, x = track["idx"].to_numpy(), track["x"].to_numpy()
        inside = {int(i) for i in np.searchsorted(at, part[part["cut"]]["idx"].to_numpy())}
        found = kernels.merged_spans(x, sorted({0, len(x)} | inside), least, apart) if len(x) else []
        return pd.DataFrame([(part["chrom"].iloc[0], at[a], at[b - 1] + 1) for a, b in found], columns=["chrom", "start", "end"])

    return both.groupBy("chrom").applyInPandas(merge, "chrom string, start bigint, end bigint")


def block_bounds(contacts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, start, end): stretches within a block of contacts (i, j, value) whose rows vary together. A task holds one
    block's matrix; a block is as wide as the flanks of a rearrangement, which the axis bounds."""
    kinds = ", ".join(f"{k} {contacts.schema[k].dataType.simpleString()}" for k in keys)

    def find(part: pd.DataFrame) -> pd.DataFrame:
        lo, n = int(part["i"].min()), int(part["i"].max() - part["i"].min()) + 1
        m = int(part["j"].max() - part["j"].min()) + 1
        dense = np.zeros((n, m))
        np.add.at(dense, (part["i"] - lo, part["j"] - part["j"].min()), part["value"])
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), lo + a, lo + b) for a, b in kernels.block_bounds(dense)], columns=[*keys, "start", "end"])

    return contacts.groupBy(*keys).applyInPandas(find, f"{kinds}, start bigint, end bigint")
