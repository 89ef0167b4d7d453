"""Loop calls: labels, merging across resolutions, and gene search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.intervals import overlap
from contactloom.operators.written import written

KEY = ("chrom1", "start1", "end1", "chrom2", "start2", "end2")


def labels_of(rows: DataFrame) -> DataFrame:
    """(KEY, assembly, distance, neo): a row for each triple `id,distance,neo` of the label."""
    parts = F.split("label", ",")
    at = F.explode(F.sequence(F.lit(0), F.size(parts) - 3, F.lit(3)))
    rows = rows.select(*KEY, parts.alias("parts"), at.alias("at"))
    return rows.select(*KEY, F.get("parts", F.col("at")).alias("assembly"), F.get("parts", F.col("at") + 1).cast("long").alias("distance"), F.get("parts", F.col("at") + 2).cast("int").alias("neo"))


def labelled(rows: DataFrame) -> DataFrame:
    """(KEY, label): the distinct triples of each loop, sorted, in one label."""
    each = F.concat_ws(",", "assembly", F.col("distance").cast("string"), F.col("neo").cast("string"))
    return rows.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set(each)), ",").alias("label"))


def across_resolutions(by_resolution: dict[int, DataFrame]) -> DataFrame:
    """(resolution, KEY, assembly, distance, neo) of labelled loops at several bin sizes, from fine to coarse. A coarse loop
    adds its labels to the finer loops inside it; it stays a loop of its own if any finer level has none. Bins of the
    finer level from start//size to end//size, both included, count as inside."""
    sizes = sorted(by_resolution)
    names = (*KEY, "assembly", "distance", "neo")
    finest = written(by_resolution[sizes[0]].select(*names), "calls")
    parts = [finest.select(F.lit(sizes[0]).alias("resolution"), *names)]
    levels = {sizes[0]: written(finest.select(*KEY).distinct(), "level")}
    for size in sizes[1:]:
        coarse = written(by_resolution[size].select(*names), "calls")
        loops = coarse.select(*KEY).distinct()
        hits = None  # (KEY, fine, f1, f2): the finer loops inside each, of all finer levels
        for fine, known in levels.items():
            keys = loops
            for s in "12":
                ends = [F.floor(F.col(f"{c}{s}") / fine) * fine for c in ("start", "end")]
                keys = keys.withColumn(f"f{s}", F.explode(F.sequence(*ends, F.lit(fine).cast("long"))))
            met = keys.join(known.select("chrom1", "chrom2", *[F.col(f"start{s}").alias(f"f{s}") for s in "12"]), ["chrom1", "chrom2", "f1", "f2"])
            met = met.select(*KEY, F.lit(fine).alias("fine"), "f1", "f2")
            hits = met if hits is None else hits.unionByName(met)
        hits = written(hits, "hits")
        moved = coarse.join(hits, list(KEY)).select(F.col("fine").alias("resolution"), "chrom1", F.col("f1").alias("start1"), (F.col("f1") + F.col("fine")).alias("end1"), "chrom2", F.col("f2").alias("start2"), (F.col("f2") + F.col("fine")).alias("end2"), "assembly", "distance", "neo")
        everywhere = hits.groupBy(*KEY).agg(F.countDistinct("fine").alias("n")).where(F.col("n") == len(levels))
        own = written(coarse.join(everywhere, list(KEY), "left_anti"), "own")
        parts += [moved, own.select(F.lit(size).alias("resolution"), *names)]
        levels[size] = own.select(*KEY).distinct()
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def gene_search(calls: DataFrame, genes: DataFrame, least: int = 15_000) -> DataFrame:
    """(gene, assembly): genes that overlap an anchor of a neo loop, anchors widened to `least`."""
    half = lambda s: F.floor((least - (F.col(f"end{s}") - F.col(f"start{s}"))) / 2)
    narrow = lambda s: (F.col(f"end{s}") - F.col(f"start{s}")) < least
    anchors = [calls.where("neo = 1").select(F.col(f"chrom{s}").alias("chrom"), F.when(narrow(s), F.greatest(F.lit(0), F.col(f"start{s}") - half(s))).otherwise(F.col(f"start{s}")).alias("start"), F.when(narrow(s), F.col(f"end{s}") + half(s)).otherwise(F.col(f"end{s}")).alias("end"), "assembly") for s in "12"]
    return overlap(anchors[0].unionByName(anchors[1]).distinct(), genes.select("chrom", "start", "end", "gene")).select(F.col("b_gene").alias("gene"), F.col("a_assembly").alias("assembly")).distinct()


def longest_records(genes: DataFrame) -> DataFrame:
    """Of records with one gene name the longest, the smallest key in a tie."""
    best = genes.groupBy("gene").agg(F.max_by(F.struct(*genes.columns), F.struct(F.col("end") - F.col("start"), -F.col("key"))).alias("r"))
    return best.select("r.*")
