"""The axis of an assembly: its blocks of bins in traversal order, and contacts and calls moved to it and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactloom.functions import kernels
from contactloom.operators.written import shuffles, written


def axis(blocks: DataFrame, bins: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, idx, block, bin_id, chrom, start) of blocks (*keys, block, chrom, lo, hi, strand, offset), bounds in bins; a -
    block runs backwards. Keys name axes, such as assemblies; what follows works on all of them at once."""
    rows = blocks.select(*keys, "block", "chrom", "lo", "hi", "strand", "offset", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("at"))
    idx = F.col("offset") + F.when(F.col("strand") == "+", F.col("at") - F.col("lo")).otherwise(F.col("hi") - 1 - F.col("at"))
    rows = rows.select(*keys, idx.alias("idx"), "block", "chrom", (F.col("at") * size).alias("start"))
    return rows.join(bins.select("chrom", "start", "bin_id"), ["chrom", "start"])


def classes(blocks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, members): of axes (key) of equal blocks those of the first by order, and (like, key), which axis each is like.
    Axes of equal blocks hold equal contacts, so that what follows from these is worked out once a class."""
    held = F.array_sort(F.collect_list(F.struct("block", "chrom", "lo", "hi", "strand", "offset")))
    shapes = written(blocks.groupBy(key).agg(held.alias("blocks")), "shapes")
    first = written(shapes.groupBy("blocks").agg(F.min(key).alias("like")), "classes")
    members = shapes.join(first, "blocks").select("like", key)
    return first.select(F.col("like").alias(key), F.explode("blocks").alias("b")).select(key, "b.*"), members


def for_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows of the first axis of each class, for all axes like it."""
    return rows.withColumnRenamed(key, "like").join(members, "like").select(*rows.columns)


def is_one_to_one(frame: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, ok): whether no bin stands on the axis twice; without keys one row."""
    return frame.groupBy(*keys).agg((F.count(F.lit(1)) == F.countDistinct("bin_id")).alias("ok"))


#: Bins a side of the cells by which contacts find the axes that hold both of their bins.
CELL = 64


def met_cells(pixels: DataFrame, place: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """For contacts (lo, hi, count, c1, c2) and places (*keys, bin_id, ...) the pairs of cells that an axis has bins in and
    contacts lie in: (*keys, a, b), the pairs of places of those where these are few, and (*keys, c1, c2), those where there
    are fewer contacts than a fourth of them."""
    held = F.struct(*[c for c in place.columns if c not in keys])
    cells = place.groupBy(*keys, F.floor(F.col("bin_id") / CELL).alias("c1")).agg(F.collect_list(held).alias("at1"))
    pairs = cells.join(cells.withColumnsRenamed({"c1": "c2", "at1": "at2"}), list(keys)).where("c1 <= c2")
    pairs = pairs.join(pixels.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")), ["c1", "c2"])
    few = F.size("at1").cast("long") * F.size("at2") <= 4 * F.col("n")
    ways = pairs.where(few).select(*keys, F.explode("at1").alias("a"), "at2").select(*keys, "a", F.explode("at2").alias("b"))
    return ways.where("a.bin_id <= b.bin_id"), pairs.where(~few).select(*keys, "c1", "c2")


def remapped(pixels: DataFrame, frame: DataFrame, keys: tuple[str, ...] = (), weights: DataFrame | None = None) -> DataFrame:
    """(*keys, i, j, count) with i <= j on the axis; with bin weights also `balanced`, the sum of counts times both weights,
    0 where a bin is masked. With keys an axis looks up the contacts of its pairs of places, cell by cell of bins, or gets
    those of the cell where they are fewer, so that a locus on many axes isn't multiplied by what these lack."""
    place = frame.select(*keys, "bin_id", "idx")
    if weights is not None:
        known = weights.where(F.col("weight") > 0).select("bin_id", "weight")
        place = place.join(known, "bin_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    lo, hi = F.least("bin1_id", "bin2_id"), F.greatest("bin1_id", "bin2_id")
    held = F.struct(*[c for c in place.columns if c not in keys])
    ends = lambda s: place.select(*keys, F.col("bin_id").alias(f"bin{s}_id"), held.alias("ab"[s - 1]))
    if keys:
        pixels = pixels.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.sum("count").alias("count"))
        pixels = written(pixels.withColumns({"c1": F.floor(F.col("lo") / CELL), "c2": F.floor(F.col("hi") / CELL)}), "pixels")
        ways, rest = met_cells(pixels, place, keys)
        rows = ways.withColumns({"lo": F.col("a.bin_id"), "hi": F.col("b.bin_id")}).join(pixels.select("lo", "hi", "count"), ["lo", "hi"]).select(*keys, "a", "b", "count")
        rest = rest.join(pixels.withColumnsRenamed({"lo": "bin1_id", "hi": "bin2_id"}), ["c1", "c2"])
        rows = rows.unionByName(rest.join(ends(1), ["bin1_id", *keys]).join(ends(2), ["bin2_id", *keys]).select(*keys, "a", "b", "count"))
    else:
        rows = pixels.join(ends(1), "bin1_id").join(ends(2), "bin2_id")
    sums = [F.sum("count").alias("count")] + ([] if weights is None else [F.sum(F.col("count") * F.col("a.weight") * F.col("b.weight")).alias("balanced")])
    rows = rows.select(*keys, F.least("a.idx", "b.idx").alias("i"), F.greatest("a.idx", "b.idx").alias("j"), "count", *([] if weights is None else ["a", "b"]))
    return rows.groupBy(*keys, "i", "j").agg(*sums)


def tight(calls: DataFrame, frame: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls (*keys, chrom1, start1, chrom2, start2, ...) both of whose anchors are bins of the axis."""
    for s in "12":
        ends = frame.select(*keys, F.col("chrom").alias(f"chrom{s}"), F.col("start").alias(f"start{s}")).distinct()
        calls = calls.join(ends, [*keys, f"chrom{s}", f"start{s}"], "left_semi")
    return calls


def picked(calls: DataFrame, frame: DataFrame, contacts: DataFrame, size: int, only_neo: bool = False) -> DataFrame:
    """(id, i, j, count): for each call (id, chrom1, start1, end1, chrom2, start2, end2, neo) the axis cell with most
    contacts within a bin around its anchors, the first in a tie. Neo calls join two blocks, others lie in one; calls of
    another bin size are left out."""
    place = frame.select("idx", "block", "chrom", "start")
    rows = calls.where(F.col("end1") - F.col("start1") == size)
    rows = rows.where("neo = 1") if only_neo else rows
    for s in "12":
        around = F.sequence(F.floor(F.col(f"start{s}") / size) - 1, F.ceil(F.col(f"end{s}") / size))
        rows = rows.withColumn(f"at{s}", F.explode(F.transform(around, lambda b: b * size)))
        own = place.select(F.col("chrom").alias(f"chrom{s}"), F.col("start").alias(f"at{s}"), F.col("idx").alias(f"idx{s}"), F.col("block").alias(f"block{s}"))
        rows = rows.join(own, [f"chrom{s}", f"at{s}"])
    rows = rows.where((F.col("block1") != F.col("block2")) == (F.col("neo") == 1))
    rows = rows.select("id", "at1", "at2", F.least("idx1", "idx2").alias("i"), F.greatest("idx1", "idx2").alias("j")).join(contacts.select("i", "j", "count"), ["i", "j"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    best = F.min(F.struct((-F.col("count")).alias("less"), "at1", "at2", "i", "j"))
    return rows.groupBy("id").agg(best.alias("b")).select("id", "b.i", "b.j", (-F.col("b.less")).alias("count"))


#: Places that one part of an axis has when places are numbered anew.
PART = 4096


def gap_free(contacts: DataFrame, frame: DataFrame, keys: tuple[str, ...] = (), least: int = 11) -> DataFrame:
    """(*keys, idx, place): axis indices whose column of the upper triangle isn't empty, numbered anew; all indices of an axis
    where fewer than `least` would remain. A place is its rank in its part of the axis and what the parts before it hold,
    so that no window is wider than a part."""
    part = F.floor(F.col("idx") / PART)
    filled = contacts.groupBy(*keys, F.col("j").alias("idx")).agg(F.sum("count").alias("n")).where("n > 0").select(*keys, "idx", F.lit(True).alias("filled"))
    filled = written(filled, "filled") if keys else filled  # a row a place, asked for twice
    rows = frame.select(*keys, "idx").distinct().join(filled, [*keys, "idx"], "left").withColumn("part", part)
    parts = rows.groupBy(*keys, "part").agg(F.count("filled").alias("n"), F.count(F.lit(1)).alias("m"))
    whole = parts.groupBy(*keys).agg((F.sum("n") < least).alias("sparse"))
    parts = parts.join(whole, list(keys)) if keys else parts.crossJoin(F.broadcast(whole))  # one row
    size = F.when(F.col("sparse"), F.col("m")).otherwise(F.col("n"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part of 4,096 bins
    parts = parts.select(*keys, "part", "sparse", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("base"))
    rows = rows.join(parts, [*keys, "part"]).where("sparse OR filled")
    at = F.row_number().over(W.partitionBy(*keys, "part").orderBy("idx")) - 1
    return rows.select(*keys, "idx", (F.col("base") + at).cast("int").alias("place"))


def moved(rows: DataFrame, places: DataFrame, keys: tuple[str, ...] = (), back: bool = False) -> DataFrame:
    """Rows (*keys, i, j, ...) with i and j on the gap-free axis instead of the axis, without those that it lacks; `back`, the
    other way."""
    old, new = ("place", "idx") if back else ("idx", "place")
    for c in "ij":
        rows = rows.join(places.select(*keys, F.col(old).cast("long").alias(c), F.col(new).cast("long").alias(f"{c}_new")), [*keys, c]).drop(c)
    return rows.withColumnsRenamed({"i_new": "i", "j_new": "j"})


def lifted(calls: DataFrame, frame: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls (*keys, i, j) on the axis as places on the genome, the lesser (chrom, start) first, with their distance on the
    axis and whether they join two blocks."""
    a = frame.select(*keys, F.col("idx").alias("i"), F.struct("chrom", "start").alias("x"), F.col("block").alias("bx"))
    b = frame.select(*keys, F.col("idx").alias("j"), F.struct("chrom", "start").alias("y"), F.col("block").alias("by"))
    rows = calls.join(a, [*keys, "i"]).join(b, [*keys, "j"])
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    return rows.select(*keys, "i", "j", lo["chrom"].alias("chrom1"), lo["start"].alias("start1"), hi["chrom"].alias("chrom2"), hi["start"].alias("start2"), ((F.col("j") - F.col("i")) * size).alias("distance"), (F.col("bx") != F.col("by")).alias("neo"))


def lifted_intervals(rows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(id, block, lo, hi, strand): the parts of genome intervals (id, chrom, start, end, strand) within blocks, in base
    pairs of the axis; a - block turns strands."""
    from contactloom.operators.intervals import overlap

    b = blocks.select("chrom", (F.col("lo") * size).alias("start"), (F.col("hi") * size).alias("end"), "block", F.col("strand").alias("way"), (F.col("offset") * size).alias("base"))
    met = overlap(rows.select("chrom", "start", "end", "id", "strand"), b, size=100 * size)
    s, e = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    plus = F.col("b_way") == "+"
    turned = F.when(F.col("a_strand") == "+", "-").when(F.col("a_strand") == "-", "+").otherwise(F.col("a_strand"))
    return met.select(F.col("a_id").alias("id"), F.col("b_block").alias("block"), (F.col("b_base") + F.when(plus, s - F.col("b_start")).otherwise(F.col("b_end") - e)).alias("lo"), (F.col("b_base") + F.when(plus, e - F.col("b_start")).otherwise(F.col("b_end") - s)).alias("hi"), F.when(plus, F.col("a_strand")).otherwise(turned).alias("strand"))


def lifted_genes(genes: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(id, gene, block, lo, hi, strand, exon_starts, exon_sizes): genes (id, gene, chrom, start, end, strand, exons) on the axis, cut
    where their block ends, in base pairs; a - block turns them. Exons, arrays of (start, end), are lifted and cut with
    their gene; those that start after it does are given by where they start in it and their whole size. Of exons that
    start at one place the longest stays, and one that starts within the one kept before it goes. Genes without a strand
    are left out."""
    from contactloom.operators.intervals import overlap

    b = blocks.select("chrom", (F.col("lo") * size).alias("start"), (F.col("hi") * size).alias("end"), "block", F.col("strand").alias("way"), (F.col("offset") * size).alias("base"))
    rows = genes.where(F.col("strand").isin("+", "-")).select("chrom", "start", "end", "id", "gene", "strand", "exons")
    met = overlap(rows, b, size=100 * size)
    plus = F.col("b_way") == "+"
    lift = lambda x: F.col("b_base") + F.when(plus, x - F.col("b_start")).otherwise(F.col("b_end") - x)
    lo, hi = F.least(lift(F.col("a_start")), lift(F.col("a_end"))), F.greatest(lift(F.col("a_start")), lift(F.col("a_end")))
    top = F.col("b_base") + F.col("b_end") - F.col("b_start")
    met = met.withColumns({"lo": F.greatest(lo, F.col("b_base")), "hi": F.least(hi, top)}).where("hi > lo")

    def exon(e):
        first, last = F.least(lift(e["start"]), lift(e["end"])), F.greatest(lift(e["start"]), lift(e["end"]))
        return F.struct((F.greatest(first, F.col("lo")) - F.col("lo")).alias("at"), (F.col("lo") - F.greatest(first, F.col("lo")) + F.least(last, F.col("hi")) - F.col("lo")).alias("left"), (e["start"] - e["end"]).alias("less"))

    found = F.filter(F.transform("a_exons", exon), lambda x: (x["left"] > 0) & (x["at"] > 0))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["at"].cast("long").alias("at"), x["less"].cast("long").alias("less"))))
    empty = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<at: bigint, less: bigint>>").alias("kept"))
    fold = F.aggregate(ordered, empty, lambda a, x: F.when(x["at"] < a["end"], a).otherwise(F.struct((x["at"] - x["less"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))))
    met = met.withColumn("kept", fold["kept"])
    turned = F.when(plus, F.col("a_strand")).when(F.col("a_strand") == "+", "-").otherwise("+")
    return met.select(F.col("a_id").alias("id"), F.col("a_gene").alias("gene"), F.col("b_block").alias("block"), "lo", "hi", turned.alias("strand"), F.col("kept.at").alias("exon_starts"), F.transform("kept.less", lambda x: -x).alias("exon_sizes"))


def valid_pairs(frame: DataFrame, weights: DataFrame, longest: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, block1, block2, distance, n): pairs of valid bins of each pair of an axis's blocks by distance from 2 to
    `longest`, as correlations of the blocks' masks, so that no pair of bins is made. A task holds one axis's masks."""
    ok = frame.join(weights.where(F.col("weight") > 0).select("bin_id"), "bin_id").select(*keys, "block", "idx")
    kinds = ", ".join(f"{k} {ok.schema[k].dataType.simpleString()}" for k in (*keys, "block"))
    both = kinds[: kinds.rindex("block")] + f"block1 {ok.schema['block'].dataType.simpleString()}, block2 {ok.schema['block'].dataType.simpleString()}"
    names = [*keys, "block1", "block2", "distance", "n"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, (at, block) in enumerate(zip(rows["idx"], rows["block"], strict=True)):
                spans = {b: (int(at[block == b].min()), int(at[block == b].max()) + 1) for b in np.unique(block).tolist()}
                masks = {b: np.bincount(at[block == b] - spans[b][0], minlength=spans[b][1] - spans[b][0]) for b in spans}
                for x in spans:
                    for y in spans:
                        shift = spans[y][0] - spans[x][0]
                        if spans[y][1] - 1 - spans[x][0] < 2 or shift + 1 - len(masks[x]) > longest:
                            continue
                        n = np.rint(np.convolve(masks[y], masks[x][::-1])) if min(len(masks[x]), len(masks[y])) < 64 else kernels.correlated(masks[x], masks[y])
                        d = np.arange(len(n)) + shift - (len(masks[x]) - 1)
                        good = (d >= 2) & (d <= longest) & (n > 0)
                        out.append((k, x, y, d[good], n[good].astype(np.int64)))
            if not out:
                continue
            size = [len(o[3]) for o in out]
            own = np.repeat([o[0] for o in out], size)
            ends = {f"block{s}": [o[s] for o in out for _ in range(len(o[3]))] for s in (1, 2)}
            yield pd.DataFrame({**{c: rows[c].to_numpy()[own] for c in keys}, **ends, "distance": np.concatenate([o[3] for o in out]), "n": np.concatenate([o[4] for o in out])})[names]

    # an axis is one row, so that a task takes small ones in batches
    ok = ok.repartition(shuffles(frame.sparkSession), *keys) if keys else ok
    rows = ok.groupBy(*keys).agg(F.collect_list(F.struct("block", "idx")).alias("at")).select(*keys, F.col("at.block").alias("block"), F.col("at.idx").alias("idx"))
    return rows.mapInPandas(count, f"{both}, distance bigint, n bigint")


def decay(contacts: DataFrame, frame: DataFrame, weights: DataFrame, longest: int, least: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, block1, block2, distance, mean): mean balanced contact of each pair of blocks by axis distance from 2 to `longest`,
    over all pairs of valid bins; at least `least` of them, and a mean above 0."""
    ok = frame.join(weights.where(F.col("weight") > 0).select("bin_id", "weight"), "bin_id").select(*keys, "idx", "block", "weight")
    a = ok.select(*keys, F.col("idx").alias("i"), F.col("block").alias("block1"), F.col("weight").alias("w1"))
    b = ok.select(*keys, F.col("idx").alias("j"), F.col("block").alias("block2"), F.col("weight").alias("w2"))
    by = [*keys, "block1", "block2", "distance"]
    pairs = valid_pairs(frame, weights, longest, keys)
    sums = contacts.where((F.col("j") - F.col("i")).between(2, longest)).join(a, [*keys, "i"]).join(b, [*keys, "j"])
    sums = sums.withColumn("distance", F.col("j") - F.col("i")).groupBy(*by).agg(F.sum(F.col("count") * F.col("w1") * F.col("w2")).alias("total"))
    return pairs.join(sums, by).where((F.col("n") >= least) & (F.col("total") > 0)).select(*by, (F.col("total") / F.col("n")).alias("mean"))
