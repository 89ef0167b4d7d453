"""Loop calls on the axes of many assemblies at once: windows around candidates, anchors, and clusters of calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions import kernels
from contactloom.operators import models

#: Bins a side of the tiles that windows are cut from.
TILE = 64
#: Base pairs that two calls of a cluster, or two anchors, are apart at most, and that an anchor reaches to both sides
#: together (fixed values).
NEAR, REACH = 15_000, 40_000


def radius(size: int) -> int:
    return max(NEAR // size, 2)


def reach(size: int) -> int:
    """Bins that an anchor may have beside its summit: half of the widest one."""
    return (min(REACH // size, 20) if size <= 10_000 else 4) // 2


def axis_candidates(contacts: DataFrame, lower: int, upper: int, places: DataFrame | None = None, keys: tuple[str, ...] = (), value: str = "scaled", least_cells: int = 5) -> DataFrame:
    """(*keys, i, j, value): contacts on each axis between `lower` and `upper` places apart whose mean at that distance, made
    to fall with distance, is above 0. A distance that has `least_cells` cells or fewer has no mean of its own; cells without
    contacts count. `places` (*keys, place) are the axes' places."""
    near = contacts.where(F.col("j") - F.col("i") >= lower).where((F.col("j") - F.col("i") <= upper) & (F.col(value) > 0))
    sums = near.groupBy(*keys, (F.col("j") - F.col("i")).alias("distance")).agg(F.sum(value).alias("total"))
    sizes = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    span = sizes.withColumn("distance", F.explode(F.sequence(F.lit(lower).cast("long"), F.lit(upper).cast("long"))))
    means = span.where(F.col("n") - F.col("distance") > 1).join(sums, [*keys, "distance"], "left")
    cells = F.col("n") - F.col("distance")
    means = means.select(*keys, "distance", (F.coalesce("total", F.lit(0.0)) / cells).alias("mean"), (cells > least_cells).alias("told"))
    kinds = ", ".join(f"{k} {means.schema[k].dataType.simpleString()}" for k in keys)

    def fall(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("distance")
        told = part[part["told"]]
        fit = np.zeros(len(part))
        if len(told):
            fit = np.interp(part["distance"], told["distance"], kernels.isotonic_decreasing(told["mean"].to_numpy(float)))
        return part.assign(mean=fit)[[*keys, "distance", "mean"]]

    group = means.groupBy(*keys) if keys else means.withColumn("axis", F.lit(0)).groupBy("axis")
    curve = group.applyInPandas(fall, f"{kinds + ', ' if keys else ''}distance bigint, mean double")
    rows = near.withColumn("distance", F.col("j") - F.col("i")).join(curve, [*keys, "distance"])
    return rows.where("mean > 0").select(*keys, "i", "j", F.col(value).alias("value"))


def windows(candidates: DataFrame, contacts: DataFrame, curve: DataFrame, half: int = 2, value: str = "count", keys: tuple[str, ...] = (), sizes: DataFrame | None = None) -> DataFrame:
    """Candidates (*keys, bin1_id, bin2_id) with `window`, the (2 half + 1)^2 values around them, row by row, over the curve's
    at their distance; as they are where the curve ends before the window does. Windows need a tenth of nonzero cells, a
    mean above 0 in the corner of the lowest rows and columns and a centre above a tenth of it, before the division. With
    `sizes` (*keys, n) they must lie within the axis and off its diagonal.

    Values gather by tiles with a halo: a value goes to the tiles whose windows can hold it, four at most, and each tile
    cuts its windows from one small matrix. The curve, a number a distance, goes to all tasks."""
    side = 2 * half + 1
    rows = candidates.select(*keys, F.col("bin1_id").cast("long").alias("bin1_id"), F.col("bin2_id").cast("long").alias("bin2_id"))
    if sizes is not None:
        rows = rows.join(sizes.select(*keys, "n"), list(keys)) if keys else rows.crossJoin(F.broadcast(sizes.select("n")))  # one row
        rows = rows.where((F.col("bin1_id") >= half) & (F.col("bin2_id") + half + 1 <= F.col("n")) & (F.col("bin2_id") - F.col("bin1_id") - 2 >= half)).drop("n")
    tile = [*keys, "t1", "t2"]
    rows = rows.withColumns({"t1": F.floor(F.col("bin1_id") / TILE), "t2": F.floor(F.col("bin2_id") / TILE)})
    own = [f"{c}_of" for c in tile]  # the two sides of the cogroup share no column
    known = contacts.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("bin1_id").cast("long").alias("a"), F.col("bin2_id").cast("long").alias("b"), F.col(value).cast("double").alias("v"))
    for c, t in (("a", "t1_of"), ("b", "t2_of")):
        known = known.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - half) / TILE), F.floor((F.col(c) + half) / TILE))))
    known = known.join(rows.select(*tile).distinct().toDF(*own), own, "left_semi")
    told = curve.select(F.col("distance").cast("long").alias("distance"), F.col("value").cast("double").alias("e")).toPandas()  # as many numbers as an axis has places
    by_distance = np.full(int(told["distance"].max()) + 1 if len(told) else 0, np.nan)
    by_distance[told["distance"]] = told["e"]
    names = [*keys, "bin1_id", "bin2_id", "window", "center", "corner"]

    def cut(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return pd.DataFrame({c: [] for c in names})
        top, left = (int(wanted[t].iloc[0]) * TILE - half for t in ("t1", "t2"))
        dense = np.zeros((TILE + 2 * half, TILE + 2 * half))
        np.add.at(dense, (held["a"].to_numpy() - top, held["b"].to_numpy() - left), held["v"].to_numpy())
        x, y = wanted["bin1_id"].to_numpy(), wanted["bin2_id"].to_numpy()
        cells = np.lib.stride_tricks.sliding_window_view(dense, (side, side))[x - half - top, y - half - left]
        corner, center = cells[:, :half, :half].mean(axis=(1, 2)) if half else np.zeros(len(x)), cells[:, half, half]
        good = ((cells != 0).sum(axis=(1, 2)) >= 0.1 * side * side) & (corner > 0)
        good[good] = center[good] / corner[good] > 0.1
        x, y, cells = x[good], y[good], cells[good]
        step = np.arange(-half, half + 1)
        far = np.abs((y[:, None, None] + step[None, None, :]) - (x[:, None, None] + step[None, :, None]))
        inside = far.max(axis=(1, 2)) < len(by_distance) if len(x) else np.zeros(0, bool)
        with np.errstate(invalid="ignore", divide="ignore"):
            scaled = cells[inside] / by_distance[far[inside]] if len(by_distance) else cells[inside]
        cells = cells.copy()
        cells[inside] = np.where(np.isfinite(scaled), scaled, cells[inside])
        same = {k: [wanted[k].iloc[0]] * len(x) for k in keys}
        return pd.DataFrame({**same, "bin1_id": x, "bin2_id": y, "window": [c.ravel().tolist() for c in cells], "center": center[good], "corner": corner[good]})[names]

    kinds = "".join(f"{k} {candidates.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.groupBy(*tile).cogroup(known.groupBy(*own)).applyInPandas(cut, f"{kinds}bin1_id bigint, bin2_id bigint, window array<double>, center double, corner double")


def anchors(calls: DataFrame, keys: list[str], size: int, least: int = 2, side: str = "i") -> DataFrame:
    """(*keys, summit, lo, hi, n), hi included: stretches of places on one side of calls where these pile up, `least` or more
    at the summit. Each distinct place comes to the task with its number of calls."""
    kinds = ", ".join(f"{k} {calls.schema[k].dataType.simpleString()}" for k in keys)
    piles = calls.groupBy(*keys, F.col(side).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    apart, beside = radius(size), reach(size)

    def peaks(part: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(part["at"].tolist(), part["n"].tolist(), strict=True))
        found = kernels.pile_anchors(np.repeat(part["at"].to_numpy(), part["n"].to_numpy()), least, apart, beside)
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), s, a, b, n.get(s, 0)) for s, a, b in found], columns=[*keys, "summit", "lo", "hi", "n"])

    return piles.groupBy(*keys).applyInPandas(peaks, f"{kinds}, summit bigint, lo bigint, hi bigint, n bigint")


def clustered_by_anchors(calls: DataFrame, keys: list[str], size: int, least: int = 2, value: str = "value") -> DataFrame:
    """(*keys, i, j, members): one call a cluster for calls (*keys, i, j, value) of a block pair: the calls in the rectangle of
    an anchor of either side first, then the rest. A task holds the calls of one pair of blocks of one assembly."""
    kinds = ", ".join(f"{k} {calls.schema[k].dataType.simpleString()}" for k in keys)
    near, beside = radius(size), reach(size)

    def group(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        found = kernels.anchored_clusters(i, j, part["value"].to_numpy(float), near, least, beside)
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), i[s], j[s], len(rows)) for s, rows in found], columns=[*keys, "i", "j", "members"])

    rows = calls.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(value).alias("value"))
    return rows.groupBy(*keys).applyInPandas(group, f"{kinds}, i bigint, j bigint, members bigint")


def called(contacts: DataFrame, places: DataFrame, curve: DataFrame, scorer, least: float, lower: int, upper: int, half: int, size: int, frame: DataFrame, keys: tuple[str, ...] = (), least_calls: int = 2) -> DataFrame:
    """(*keys, i, j) on the axes: loops of contacts (*keys, i, j, value) on the gap-free axes `places` (*keys, idx, place), scored
    by windows on these and clustered by the pair of blocks of the axis they lie on."""
    sizes = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = axis_candidates(contacts, lower, upper, places, keys, "value")
    pixels = contacts.select(*keys, F.col("i").alias("bin1_id"), F.col("j").alias("bin2_id"), "value")
    seen = windows(wanted.select(*keys, F.col("i").alias("bin1_id"), F.col("j").alias("bin2_id")), pixels, curve, half, "value", keys, sizes)
    seen = seen.withColumn("window", models.smoothed(F.col("window"))).where("window IS NOT NULL")
    hits = models.scored(seen, scorer, least).select(*keys, F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j")).join(wanted, [*keys, "i", "j"])
    block = places.join(frame.select(*keys, "idx", "block"), [*keys, "idx"]).select(*keys, "place", "block")
    for c, b in (("i", "block1"), ("j", "block2")):
        hits = hits.join(block.select(*keys, F.col("place").cast("long").alias(c), F.col("block").alias(b)), [*keys, c])
    return clustered_by_anchors(hits, [*keys, "block1", "block2"], size, least_calls)


def local_maxima(calls: DataFrame, contacts: DataFrame, frame: DataFrame, reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, i, j, to_i, to_j): each call's cell with the most contacts within `reach` places to all sides, in the same pair of
    blocks; of equal ones the first by i, then j, and the call's own before others. Calls whose surroundings hang over the
    axis stay. Calls look into the cells of a grid around them, so that only neighbours meet."""
    side = max(reach, 8)
    block = frame.select(*keys, F.col("idx").cast("long").alias("idx"), "block")
    named = lambda rows, a, b: rows.join(block.toDF(*keys, a, f"{a}_block"), [*keys, a]).join(block.toDF(*keys, b, f"{b}_block"), [*keys, b])
    size = frame.groupBy(*keys).agg(F.max("idx").alias("top"))
    own = named(calls.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct(), "i", "j")
    own = own.join(size, list(keys)) if keys else own.crossJoin(F.broadcast(size))  # one row
    inside = (F.col("i") >= reach) & (F.col("j") + reach <= F.col("top"))
    near = own.where(inside)
    for c, g in (("i", "g1"), ("j", "g2")):
        near = near.withColumn(g, F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))))
    cells = named(contacts.select(*keys, F.col("i").cast("long").alias("x"), F.col("j").cast("long").alias("y"), F.col("value").alias("v")), "x", "y")
    cells = cells.withColumns({"g1": F.floor(F.col("x") / side), "g2": F.floor(F.col("y") / side)})
    met = near.join(cells, [*keys, "g1", "g2"]).where((F.abs(F.col("x") - F.col("i")) <= reach) & (F.abs(F.col("y") - F.col("j")) <= reach))
    met = met.where((F.col("x_block") == F.col("i_block")) & (F.col("y_block") == F.col("j_block")))
    mine = (F.col("x") == F.col("i")) & (F.col("y") == F.col("j"))
    best = F.min(F.struct((-F.col("v")).alias("less"), (~mine).alias("other"), "x", "y"))
    found = met.groupBy(*keys, "i", "j").agg(best.alias("b"))
    rows = own.select(*keys, "i", "j").join(found, [*keys, "i", "j"], "left")
    return rows.select(*keys, "i", "j", F.coalesce("b.x", "i").alias("to_i"), F.coalesce("b.y", "j").alias("to_j"))
